"""Mixing sources to target weights, by DataFrame functions only.

Documents fall into cells by source, language and topic.  Iterative proportional fitting rakes the cells' token weights:
in turn, each dimension's marginal is scaled to its target, until the greatest relative change of a round is at most
`tolerance`, or `rounds` are done.  Targets that no weights can meet together, as when a source has one language only, are
met by the last dimension only; `residual` says by how much a share of another misses its own, and a warning says so, too.
It is 0 up to rounding where raking has met all targets.

A document is then kept with a probability in proportion to its cell's fitted weight over its token share; the factor
is solved so that the expected tokens are `rate` of all, with probabilities of at most one.  Whether a document is kept
depends on a hash of its id only, so a run can be repeated.

Documents are read twice, to count cells and to sample.  What is iterated is the table of cells.  Up to `SMALL_CELLS` of
them lie in one partition, where ten rounds are one stage; beyond that, each round is sums that are pre-aggregated where
the cells lie and joined back, and is written to the shared folder.  The last join back to the documents has one small
side, which Spark broadcasts only below its own size limit, and otherwise may split.

Tokens are estimated as a quarter of the characters, rounded up.  A null text has 0 tokens, a null source, language or
topic is the value `(none)`.  A null id hashes as text `null`.  Repeated rows are rows of their own; rows of one id fare
alike where they are in one cell.  Other columns, whatever their names, aren't read; `sampled` keeps them.  An empty
table gives an empty result.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import fresh, own_columns, written

DIMENSIONS = ("source", "lang", "topic")
#: Targets are the present shares to these powers: smaller sources, languages and topics gain.
FLATTENING = {"source": 0.5, "lang": 0.7, "topic": 0.8}
NONE = "(none)"
SMALL_CELLS, ROUNDS_AT_ONCE = 50_000, 10


def tokens(text: Column) -> Column:
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("bigint")


def topic(text: Column) -> Column:
    """What kind of text it is, by its form: table, noise, shouting, short or long prose."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, F.lit(c), F.lit("")))) / F.greatest(n, F.lit(1))
    return F.when(text.isNull(), NONE).when(share("|") > 0.02, "table").when(share("#") + share("%") + share("*") > 0.02, "noise").when(share("!") > 0.02, "shouting").when(n < 1000, "short").otherwise("long")


def share_of(doc_id: Column) -> Column:
    """A number from 0 up to 1 that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of every row."""
    text = F.col(text_col).cast("string")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), value("source"), value("lang"), topic(text).alias("topic"), tokens(text).alias("n_tokens"))


def flattened(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """value, target: shares of tokens to a power, scaled to sum to one."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("n_tokens").alias("t")).filter("t > 0")
    raw = sums.select("value", F.pow(F.col("t").cast("double"), F.lit(power)).alias("raw"))
    total = raw.agg(F.sum("raw")).first()[0]
    return raw.select("value", (F.col("raw") / (total or 1.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 200, tolerance: float = 1e-12) -> tuple[DataFrame, int, float]:
    """Cells with a column weight whose marginals meet the targets; rounds taken, and the last change.

    cells: the dimensions and n_tokens; targets: value and target by dimension, each summing to one over its values.
    """
    total, n = cells.agg(F.sum("n_tokens"), F.count("*")).first()
    fitted = cells.filter("n_tokens > 0").withColumn("weight", F.col("n_tokens") / float(total or 1))
    targets = {d: written(t, "targets") for d, t in targets.items()}
    if n <= SMALL_CELLS:
        return _rake_in_one(fitted, targets, rounds, tolerance)
    fitted = written(fitted, "cells")
    change, done = float("inf"), 0
    while done < rounds and change > tolerance:
        was = fitted.withColumn("was", F.col("weight"))
        for d in targets:
            sums = was.groupBy(d).agg(F.sum("weight").alias("now"))
            factor = sums.join(targets[d].withColumnRenamed("value", d), d).select(d, (F.col("target") / F.col("now")).alias("factor"))
            was = was.join(factor, d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        step, done = written(was, "cells"), done + 1
        change = _changed(step)
        fitted = step.drop("was")
    return fitted, done, change


def _changed(step: DataFrame) -> float:
    return float(step.agg(F.max(F.abs(F.col("weight") / F.col("was") - 1))).first()[0] or 0.0)


def _rake_in_one(fitted: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float) -> tuple[DataFrame, int, float]:
    """The same for few cells: several rounds in one stage."""
    columns = fitted.columns
    for d, t in targets.items():
        fitted = fitted.join(t.select(F.col("value").alias(d), F.col("target").alias(f"to_{d}")), d)
    fitted, change, done = written(fitted.coalesce(1), "cells"), float("inf"), 0
    while done < rounds and change > tolerance:
        step = fitted.coalesce(1)
        for k in range(ROUNDS_AT_ONCE):
            if k == ROUNDS_AT_ONCE - 1:
                step = step.withColumn("was", F.col("weight"))
            for d in targets:
                step = step.withColumn("weight", F.col("weight") * F.col(f"to_{d}") / F.sum("weight").over(Window.partitionBy(d)))
        step, done = written(step, "cells"), done + ROUNDS_AT_ONCE
        change = _changed(step)
        fitted = step.drop("was")
    return fitted.select(columns), done, change


def with_probability(fitted: DataFrame, rate: float) -> DataFrame:
    """Adds ratio (weight over token share) and probability = min(1, factor * ratio), whose expected tokens are rate of all.

    Each turn raises the factor or ends; a cell that has reached one stays there, so the turns end.
    """
    total = fitted.agg(F.sum("n_tokens")).first()[0] or 1
    cells = fitted.withColumn("ratio", F.col("weight") * float(total) / F.col("n_tokens"))
    factor, capped = rate, -1
    while True:
        full = F.col("ratio") * factor >= 1
        sure, rest, n = cells.agg(F.sum(F.when(full, F.col("n_tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("n_tokens") * F.col("ratio"))), F.count_if(full)).first()
        if not rest or n == capped:
            break
        factor, capped = max(factor, (rate * total - sure) / rest), n
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * factor))


def residual(fitted: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The greatest difference between a value's share of the weight and its target."""
    most = 0.0
    for d, t in targets.items():
        sums = fitted.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("now"))
        found = sums.join(t, "value", "full").agg(F.max(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("target", F.lit(0.0))))).first()[0]
        most = max(most, found or 0.0)
    return most


def chances(docs: DataFrame, rate: float, flattening: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None) -> tuple[DataFrame, float]:
    """The dimensions, weight and probability of every cell with tokens; the residual."""
    flattening, targets = flattening or FLATTENING, targets or {}
    cells = written(placed(docs).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n_tokens")), "cells")
    goals = {d: targets[d] if d in targets else flattened(cells, d, flattening[d]) for d in DIMENSIONS}
    fitted, rounds, change = rake(cells, goals)
    missed = residual(fitted, goals)
    if missed > 1e-6:
        warnings.warn(f"after {rounds} rounds a share misses its target by {missed:.3g}; weights still change by {change:.3g} a round", stacklevel=2)
    return written(with_probability(fitted, rate).select(*DIMENSIONS, "weight", "probability"), "chances"), missed


def mix(docs: DataFrame, rate: float = 0.5, flattening: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled, residual of every row.

    targets: for a dimension, a table of value and target instead of the flattened shares.  A document without tokens
    weighs nothing: its cell may be left out, its probability is then that of an average document, the rate.
    """
    cells, missed = chances(docs, rate, flattening, targets)
    found = placed(docs).join(cells, list(DIMENSIONS), "left")
    weight, probability = F.coalesce("weight", F.lit(0.0)), F.coalesce("probability", F.lit(rate))
    return found.select("doc_id", *DIMENSIONS, "n_tokens", weight.alias("weight"), probability.alias("probability"), (share_of(F.col("doc_id")) < probability).alias("sampled"), F.lit(missed).alias("residual"))


def sampled(docs: DataFrame, rate: float = 0.5, **goals) -> DataFrame:
    """The rows of docs that mix() samples, with the columns of docs, whatever their names."""
    cells, _ = chances(docs, rate, **goals)
    names = {c: fresh(docs, f"cell_{c}") for c in (*DIMENSIONS, "probability")}
    cells = cells.select(*(F.col(c).alias(name) for c, name in names.items()))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    same = (value("source") == F.col(names["source"])) & (value("lang") == F.col(names["lang"])) & (topic(F.col("text").cast("string")) == F.col(names["topic"]))
    kept = docs.join(cells, same, "left").filter(share_of(F.col("doc_id").cast("bigint")) < F.coalesce(names["probability"], F.lit(rate)))
    return kept.select(*own_columns(docs))
