"""What filters do to one another in every order they can be applied in, from a histogram of failure masks.

Each filter is a condition that a text fails, one bit of its mask; the last also asks for a smaller id with the same
text.  Rows are counted by text, part and label before anything is joined, so a text that a third of all rows have is a
few rows by then.  A part's counts by mask (32 cells for five filters) are all that the orders need: a row is alive after
some filters if its mask has none of their bits, so every order and step is a difference of two entries of a table of
subsets, and a Shapley value is a weighted sum of such differences.

Only DataFrame functions run.  Texts meet by their SHA-256 digest.  A null text counts as empty, a null part as the empty
string.  Rows without an id have no smaller one and are smaller than none; rows that repeat an id are rows of their own,
and don't count as copies of one another.  A label says yes if any row of its id does.  Other columns aren't read.  An
empty table has no part and gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import own_columns, written

_SPACE = r"[\x20\x09-\x0D]+"
#: Letters of the filters that look at one text, and what a text that fails has; columns text, n_words, n_distinct, n_upper.
FILTERS: dict[str, str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 2 * length(text)",
    "D": r"text RLIKE '[#$%&*|]'",
}
#: The letter of the filter that a copy of a smaller id's text fails.
COPY = "E"
LABELS = {"good": "quality", "toxic": "toxic"}


def measured(docs: DataFrame) -> DataFrame:
    """docs (with a string column text) with n_words, n_distinct and n_upper."""
    words = F.array_remove(F.split("text", _SPACE), "")
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return docs.withColumn("words", words).withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words")), "n_upper": upper}).drop("words")


def masks(df: DataFrame, filters: Mapping[str, str] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, digest, mask of every row: bit k of the mask is set if the text fails filter k.  Copies aren't known yet."""
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = [F.when(F.expr(c), F.lit(1 << k)).otherwise(0) for k, c in enumerate(filters.values())]
    return measured(docs).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))


def _labelled(rows: DataFrame, labels: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    yes = {name: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for name, c in flags.items()}
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*yes.values())
    return rows.join(known, "doc_id", "left").fillna(0, list(flags))


def cells(df: DataFrame, labels: DataFrame, filters: Mapping[str, str] = FILTERS, flags: Mapping[str, str] = LABELS, **columns: str) -> DataFrame:
    """part, mask, n and a count for each flag: the histogram of whole masks, copies included, in each part."""
    copy = 1 << len(filters)
    rows = _labelled(masks(df, filters, **columns), labels, flags)
    by_id = rows.groupBy("doc_id", "digest", "part", "mask", *flags).agg(F.count("*").alias("n"))
    # Of each text, part and label: its rows, its least id and the rows that have it; min_by takes ids that are there.
    own = by_id.groupBy("digest", "part", "mask", *flags).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"))
    own = written(own, "texts")
    first = own.groupBy("digest").agg(F.min("least").alias("first"))
    both = own.join(first, "digest")
    firsts = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    dealt = both.select("part", *flags, F.inline(F.array(F.struct(F.col("mask"), firsts.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - firsts).alias("n")))))
    return dealt.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(f)).alias(f) for f in flags)).filter("n > 0")


def orders(histogram: DataFrame, letters: str = "".join(FILTERS) + COPY, flags: Mapping[str, str] = LABELS) -> DataFrame:
    """One row for each part, order of the filters and step, from the cells of each part."""
    every = (1 << len(letters)) - 1
    subsets = range(every + 1)
    counts = ["n", *flags]
    # alive: by subset of the filters, the rows that fail none of them.
    alive = [F.array(*(F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c))), F.lit(0)) for s in subsets)).alias(f"alive_{c}") for c in counts]
    alone = F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == 1 << k, F.col("n"))), F.lit(0)) for k in range(len(letters)))).alias("alone")
    parts = histogram.groupBy("part").agg(*alive, alone)
    at = lambda c, s: F.get(f"alive_{c}", s)
    value = []
    for k in range(len(letters)):
        others = [s for s in subsets if not s >> k & 1]
        orders_with = lambda s: math.factorial(s.bit_count()) * math.factorial(len(letters) - 1 - s.bit_count())
        value.append(sum((orders_with(s) * (at("n", F.lit(s)) - at("n", F.lit(s | 1 << k))) for s in others), F.lit(0)))
    parts = parts.withColumn("shapley", F.array(*value))
    every_order = F.explode(F.lit(["".join(p) for p in itertools.permutations(letters)])).alias("filter_order")
    steps = parts.select(*own_columns(parts), every_order).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    bit = lambda j: F.instr(F.lit(letters), F.substring("filter_order", j, F.lit(1))) - 1
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda s, j: F.when(j == 0, s).otherwise(s.bitwiseOR(F.call_function("shiftleft", F.lit(1), bit(j)))))
    steps = steps.withColumns({"own": bit(F.col("step")), "before": before}).withColumn("after", F.col("before").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("own"))))
    gone = lambda c: at(c, F.col("before")) - at(c, F.col("after"))
    failing = at("n", F.lit(0)) - at("n", F.call_function("shiftleft", F.lit(1), F.col("own")))
    lost = [gone(f).alias(f"{f}_lost") for f in flags]
    return steps.select("part", "filter_order", "step", at("n", F.col("after")).alias("kept"), gone("n").alias("removed"), (failing - gone("n")).alias("redundant"), F.get("alone", F.col("own")).alias("unique_fails"), *lost, F.get("shapley", F.col("own")).alias("shapley"))


def audit(df: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: five filters, 120 orders."""
    return orders(cells(df, labels, **columns))
