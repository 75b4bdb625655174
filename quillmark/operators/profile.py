"""Dataset profiles: five pipelines, each a few wide aggregates over one scan.

Nothing here orders a whole table in one partition.  Exact order statistics come from brackets: approximate percentiles
enclose each wanted rank until a bracket is small, then the values inside it are counted.  An empty table has a row for
each column, too, with zero counts and shares, and without statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmark.functions.coerce import finite, is_missing, js_round, trim_ws, value_kind
from quillmark.sources.shared import checkpointed, running_sums

DUPLICATE_CAP, PAIR_COLUMNS, HIGH_MISSING, TOGETHER, UNIQUE, MAJORITY, COMPOSITES, CANDIDATES, TOP = 5000, 4, 20.0, 0.3, 0.98, 0.5, 2, 3, 5
#: Rows inside a bracket up to which its values are counted one by one; beyond it the bracket is narrowed.
BRACKET_VALUES = 200_000


@dataclass(frozen=True)
class DatasetSpec:
    """What a table doesn't say itself: file name, logical column types, and the columns that give its row order."""

    file_name: str = "dataset.csv"
    kinds: dict[str, str] = field(default_factory=dict)
    order: tuple[str, ...] = ()

    def kind(self, df: DataFrame, name: str) -> str:
        return self.kinds.get(name) or logical_kind(df.schema[name].dataType)

    @property
    def format(self) -> str:
        return self.file_name.rsplit(".", 1)[-1].lower()


def logical_kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.StringType):
        return "categorical"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "boolean" if isinstance(t, T.BooleanType) else "unknown"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def first_rows(df: DataFrame, spec: DatasetSpec, cap: int | None = DUPLICATE_CAP) -> DataFrame:
    """The first rows in the dataset's order, which TakeOrderedAndProject finds; all with cap None."""
    if cap is None:
        return df
    return df.orderBy(*spec.order).limit(cap) if spec.order else df.limit(cap)


def duplicate_rows(df: DataFrame, spec: DatasetSpec, cap: int | None = DUPLICATE_CAP) -> tuple[int, int]:
    """Rows that repeat another one, and rows looked at."""
    groups = first_rows(df, spec, cap).groupBy(*df.columns).count()
    found = groups.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    return found[0] - found[1], found[0]


def dataset_profile(df: DataFrame, spec: DatasetSpec, cap: int | None = DUPLICATE_CAP) -> DataFrame:
    """One row: sizes, types, duplicate and empty rows, empty and constant columns."""
    repeated, looked = duplicate_rows(df, spec, cap)
    aggregates = [F.count("*").alias("rows")]
    empty_row = F.lit(True)
    for c in df.columns:
        missing = is_missing(F.col(c))
        empty_row = empty_row & missing
        aggregates += [F.count_if(missing).alias(f"m_{c}"), F.min(F.when(~missing, _text(c))).alias(f"lo_{c}"), F.max(F.when(~missing, _text(c))).alias(f"hi_{c}")]
    sums = df.agg(*aggregates, F.count_if(empty_row).alias("empty_rows"))
    empty = sum((F.when(F.col(f"m_{c}") == F.col("rows"), 1).otherwise(0) for c in df.columns), F.lit(0))
    constant = F.array_compact(F.array(*(F.when(F.col(f"lo_{c}") == F.col(f"hi_{c}"), F.lit(c)) for c in df.columns)))
    kinds: dict[str, int] = {}
    for c in df.columns:
        kinds[spec.kind(df, c)] = kinds.get(spec.kind(df, c), 0) + 1
    return sums.select(
        F.lit(spec.file_name).alias("file_name"), "rows", F.lit(len(df.columns)).alias("cols"),
        (F.col("rows") * max(1, len(df.columns)) * 8).alias("file_size_estimate"),
        F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)).alias("column_count_by_type"),
        F.lit(repeated).cast("bigint").alias("duplicate_rows"),
        js_round(F.lit(100.0 * repeated / looked if looked else 0.0), 2).alias("duplicate_pct"),
        "empty_rows", empty.alias("empty_cols"), constant.alias("constant_cols"), F.lit(spec.format).alias("format"),
    )


def long_format(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (text, null if missing): one row for each cell.  Distinct counts then need one shuffle in all."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.when(~is_missing(F.col(c)), _text(c)).alias("value")) for c in columns))
    return df.select(F.inline(cells))


def _every(df: DataFrame, columns: list[str], **values: Column) -> DataFrame:
    """df with a row for each of columns; values: what a column without a row has."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(df, "column", "left").select("column", *(F.coalesce(c, values[c]).alias(c) if c in values else F.col(c) for c in df.columns if c != "column"))


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, missing, missing_pct, unique, cardinality_ratio."""
    values = long_format(df, columns).groupBy("column", "value").count()
    n = F.sum("count")
    missing = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0))
    found = values.groupBy("column").agg(n.alias("rows"), missing.alias("missing"), F.count("value").alias("unique"))
    none = F.lit(0).cast("bigint")
    found = _every(found, columns, rows=none, missing=none, unique=none)
    n = F.greatest(F.lit(1), F.col("rows"))
    return found.select("column", "rows", "missing", js_round(100.0 * F.col("missing") / n, 2).alias("missing_pct"), "unique", js_round(F.col("unique") / n, 3).alias("cardinality_ratio"))


def values_at(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """The values at 0-based ranks of the ascending order of each column (double, nulls left out).

    Each rank has a bracket of values that holds it, at first all of them.  A pass over the table cuts every bracket
    with more than `BRACKET_VALUES` rows by percentiles of its own rows, all of them in one long format, and keeps the
    cut around the rank.  A bracket of equal values, or one that no cut makes smaller, is done; so each pass divides the
    rest by more than a thousand.  One more pass counts the values inside.
    """
    ranks = {c: sorted(set(r)) for c, r in ranks.items() if r}
    if not ranks:
        return {}
    first = df.agg(*(x for c in ranks for x in (F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")))).first()
    # (column, rank): least and greatest value, rows inside, rows below.
    found = {(c, r): (first[f"lo_{c}"], first[f"hi_{c}"], first[f"n_{c}"], 0) for c, rs in ranks.items() for r in rs}
    done: set[tuple[str, int]] = set()
    while todo := [key for key, (lo, hi, n, _) in found.items() if key not in done and lo != hi and n > BRACKET_VALUES]:
        for (c, r), cut in _narrowed(df, {key: found[key] for key in todo}).items():
            if cut[2] >= found[c, r][2]:
                done.add((c, r))
            found[c, r] = cut
    inside = _inside(df, found).groupBy("column", "rank", "value").agg(F.count("*").alias("n"))
    below = Window.partitionBy("column", "rank").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.create_map(*(F.lit(x) for (c, r), (_, _, _, at) in found.items() for x in (f"{c}/{r}", at)))
    upto = inside.withColumn("upto", F.sum("n").over(below) + start[F.concat("column", F.lit("/"), F.col("rank").cast("string"))])
    rows = upto.filter(F.col("upto") > F.col("rank")).groupBy("column", "rank").agg(F.min("value").alias("value")).collect()
    out: dict[str, dict[int, float]] = {c: {} for c in ranks}
    for row in rows:
        out[row["column"]][row["rank"]] = row["value"]
    return out


Brackets = dict[tuple[str, int], tuple[float, float, int, int]]


def _inside(df: DataFrame, brackets: Brackets) -> DataFrame:
    """column, rank, value: of the rows inside each bracket."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(r).cast("bigint").alias("rank"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.col(c).alias("value")) for (c, r), (lo, hi, _, _) in brackets.items()))
    return df.select(F.inline(cells)).filter("value between lo and hi").select("column", "rank", "value")


def _narrowed(df: DataFrame, brackets: Brackets, accuracy: int = 10_000) -> Brackets:
    """Of each bracket the part around its rank, with the rows in it and below it."""
    place = {(c, r): (r - below, n) for (c, r), (_, _, n, below) in brackets.items()}
    share = lambda key, step: min(1.0, max(0.0, (place[key][0] + step) / place[key][1] + step / accuracy))
    shares = sorted({share(key, step) for key in brackets for step in (-2, 2)})
    cuts = _inside(df, brackets).groupBy("column", "rank").agg(F.percentile_approx("value", shares, accuracy).alias("at")).collect()
    ends = {}
    for row in cuts:
        key = (row["column"], row["rank"])
        ends[key] = tuple(row["at"][shares.index(share(key, step))] for step in (-2, 2))
    lo = F.create_map(*(F.lit(x) for (c, r), (a, _) in ends.items() for x in (f"{c}/{r}", a)))
    hi = F.create_map(*(F.lit(x) for (c, r), (_, b) in ends.items() for x in (f"{c}/{r}", b)))
    name = F.concat("column", F.lit("/"), F.col("rank").cast("string"))
    sums = _inside(df, brackets).groupBy("column", "rank").agg(F.count_if(F.col("value") < lo[name]).alias("under"), F.count_if(F.col("value").between(lo[name], hi[name])).alias("n")).collect()
    out: Brackets = {}
    for row in sums:
        key = (row["column"], row["rank"])
        under = brackets[key][3] + row["under"]
        # Percentiles are approximate: a part that misses the rank isn't taken.
        out[key] = (*ends[key], row["n"], under) if under <= key[1] < under + row["n"] else brackets[key]
    return out


def numeric_counts(df: DataFrame, spec: DatasetSpec, columns: list[str] | None = None) -> DataFrame:
    """column, x, n: how often each finite value occurs.  The state of a numeric profile, which merged_counts() merges."""
    columns = columns or [c for c in df.columns if spec.kind(df, c) == "numeric"]
    cells = F.array(*(F.struct(F.lit(c).alias("column"), finite(F.col(c), logical_kind(df.schema[c].dataType)).alias("x")) for c in columns))
    return df.select(F.inline(cells)).filter("x is not null").groupBy("column", "x").agg(F.count("*").alias("n"))


def merged_counts(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The state of all rows together, from the states of parts: what was counted isn't read again."""
    for other in others:
        first = first.unionByName(other)
    return first.groupBy("column", "x").agg(F.sum("n").alias("n"))


def numeric_profile(df: DataFrame, spec: DatasetSpec, columns: list[str] | None = None) -> DataFrame:
    """column and its statistics over finite values: profile_of_counts() of all rows, which are read once."""
    columns = columns or [c for c in df.columns if spec.kind(df, c) == "numeric"]
    return profile_of_counts(numeric_counts(df, spec, columns), columns)


def folder_profile(frames: dict[str, DataFrame], specs: dict[str, DatasetSpec] | None = None) -> DataFrame:
    """numeric_profile() of the numeric columns of many tables at once, as `table.column`: one state, ranks keyed by column."""
    state, columns = None, []
    for name, df in frames.items():
        spec = (specs or {}).get(name, DatasetSpec(name))
        own = [c for c in df.columns if spec.kind(df, c) == "numeric"]
        if own:
            counts = numeric_counts(df, spec, own).withColumn("column", F.concat(F.lit(f"{name}."), "column"))
            state = counts if state is None else state.unionByName(counts)
            columns += [f"{name}.{c}" for c in own]
    if state is None:
        raise ValueError("no table has a numeric column")
    return profile_of_counts(state, columns)


def profile_of_counts(counts: DataFrame, columns: list[str]) -> DataFrame:
    """column and its statistics from a state; statistics are null for a column without a finite value.

    Quartiles are the values at floor(n * p) of the ascending order, variance is that of a sample and 0 for one value,
    skewness and kurtosis use the sample deviation and are 0 for fewer than three values or none that differ.  Ranks come
    from sums over ranges of the values, so no task holds a column.
    """
    counts = checkpointed(counts)
    basics = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.sum(F.col("x") * F.col("n")).alias("total"), F.min("x").alias("min"), F.max("x").alias("max"), F.max_by("x", F.struct("n", -F.col("x"))).alias("mode"))
    basics = F.broadcast(checkpointed(basics.withColumn("mean", F.col("total") / F.col("rows"))))  # a row for each column
    placed = running_sums(counts, "column", [F.col("x")], {"upto": "n"}).join(basics, "column")
    off, n, last = F.col("x") - F.col("mean"), F.col("n"), F.col("rows") - 1
    at = lambda rank, name: F.min(F.when(F.col("upto") > rank, F.col("x"))).alias(name)
    ranks = (at(F.expr("rows div 4"), "q1"), at(F.expr("rows * 3 div 4"), "q3"), at(F.expr("(rows - 1) div 2"), "low"), at(F.expr("rows div 2"), "high"))
    found = placed.groupBy("column").agg(F.sum(n * off * off).alias("m2"), F.sum(n * off * off * off).alias("m3"), F.sum(n * off * off * off * off).alias("m4"), *ranks).join(basics, "column")
    found = _every(found.withColumn("variance", F.when(last > 0, F.col("m2") / last).otherwise(0.0)), columns, rows=F.lit(0).cast("bigint"))
    flat = (F.col("rows") < 3) | (F.col("variance") == 0)
    some, total, s = F.col("rows") > 0, F.col("rows"), F.sqrt("variance")
    return found.select(
        "column", total.alias("n"), js_round(F.col("mean"), 3).alias("mean"), js_round((F.col("low") + F.col("high")) / 2, 3).alias("median"), "mode", "min", "max",
        js_round(F.col("max") - F.col("min"), 3).alias("range"), js_round(F.col("q1"), 3).alias("q1"), js_round(F.col("q3"), 3).alias("q3"), js_round(F.col("q3") - F.col("q1"), 3).alias("iqr"),
        F.when(some, js_round(F.col("variance"), 3)).alias("variance"), F.when(some, js_round(s, 3)).alias("std"),
        F.when(some, F.when(flat, 0.0).otherwise(js_round(F.try_divide(F.col("m3") / total, s * s * s), 3))).alias("skewness"),
        F.when(some, F.when(flat, 0.0).otherwise(js_round(F.try_divide(F.col("m4") / total, s * s * s * s) - 3, 3))).alias("kurtosis"),
    )


def categorical_values(df: DataFrame, spec: DatasetSpec, columns: list[str]) -> DataFrame:
    """column, value, count, first: frequencies of non-missing values, and the first row in order that has it."""
    first = F.struct(*spec.order) if spec.order else F.lit(0)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.when(~is_missing(F.col(c)), _text(c)).alias("value"), first.alias("at")) for c in columns))
    return df.select(F.inline(cells)).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"), F.min("at").alias("first"))


def top_values(df: DataFrame, spec: DatasetSpec, columns: list[str], k: int = TOP) -> DataFrame:
    """column, rank, value, count, pct: the k most frequent values, ties in order of first appearance."""
    values = categorical_values(df, spec, columns)
    total = values.groupBy("column").agg(F.sum("count").alias("total"))
    best = Window.partitionBy("column").orderBy(F.desc("count"), "first", "value")
    ranked = values.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(total), "column").select("column", "rank", "value", "count", js_round(100.0 * F.col("count") / F.col("total"), 2).alias("pct"))


def categorical_profile(df: DataFrame, spec: DatasetSpec, columns: list[str]) -> DataFrame:
    """column, entropy in bits, mode: of non-missing values."""
    values = categorical_values(df, spec, columns)
    # Entropy from sums alone: log2(total) - sum(c * log2(c)) / total.
    c = F.col("count")
    sums = values.groupBy("column").agg(F.sum("count").alias("total"), F.sum(c * F.log2(c)).alias("s"), F.min(F.struct((-c).alias("minus"), "first", "value")).alias("best"))
    return sums.select("column", js_round(F.log2("total") - F.col("s") / F.col("total"), 2).alias("entropy"), F.col("best.value").alias("mode"))


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, missing, missing_pct, high: of every column."""
    columns = columns or df.columns
    sums = df.agg(F.count("*").alias("rows"), *(F.count_if(is_missing(F.col(c))).alias(c) for c in columns))
    pct = 100.0 * F.col("missing") / F.greatest(F.lit(1), F.col("rows"))
    long = sums.select("rows", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns))))
    return long.select("column", "missing", js_round(pct, 2).alias("missing_pct"), (pct > HIGH_MISSING).alias("high"))


def missing_per_row(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """avg_missing_per_row, max_missing_per_row."""
    count = sum((is_missing(F.col(c)).cast("int") for c in columns or df.columns), F.lit(0))
    return df.agg(js_round(F.coalesce(F.avg(count), F.lit(0.0)), 2).alias("avg_missing_per_row"), F.coalesce(F.max(count), F.lit(0)).alias("max_missing_per_row"))


def missing_together(df: DataFrame, columns: list[str] | None = None, most: int = PAIR_COLUMNS, least: float = TOGETHER) -> DataFrame:
    """a, b, coefficient of pairs among the first columns with some but not all values missing: both / sqrt(product)."""
    columns = columns or df.columns
    sums = df.agg(F.count("*").alias("rows"), *(F.count_if(is_missing(F.col(c))).alias(c) for c in columns)).first()
    some = [c for c in columns if 0 < sums[c] < sums["rows"]][:most]
    pairs = list(combinations(some, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, coefficient double")
    both = df.agg(*(F.count_if(is_missing(F.col(a)) & is_missing(F.col(b))).alias(f"{a}/{b}") for a, b in pairs))
    share = lambda a, b: F.col(f"`{a}/{b}`") / float((sums[a] * sums[b]) ** 0.5)
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), share(a, b).alias("raw")) for a, b in pairs))
    return both.select(F.inline(rows)).filter(F.col("raw") > least).select("a", "b", js_round(F.col("raw"), 2).alias("coefficient"))


def key_profile(df: DataFrame, spec: DatasetSpec, columns: list[str] | None = None) -> DataFrame:
    """column, unique_col, candidate_key, high_cardinality of every column."""
    columns = columns or df.columns
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(_text(c), F.lit("")).alias("raw"), is_missing(F.col(c)).alias("missing")) for c in columns))
    values = df.select(F.inline(cells)).groupBy("column", "raw", "missing").count()
    by = values.groupBy("column").agg(F.sum("count").alias("rows"), F.count_if(~F.col("missing")).alias("unique"), F.coalesce(F.sum(F.when(F.col("missing"), F.col("count"))), F.lit(0)).alias("missing"), F.count("*").alias("raw"))
    none = F.lit(0).cast("bigint")
    by = _every(by, columns, rows=none, unique=none, missing=none, raw=none)
    ratio = F.col("unique") / F.greatest(F.lit(1), F.col("rows"))
    return by.select("column", ((ratio > UNIQUE) & (F.col("missing") == 0)).alias("unique_col"), ((ratio == 1) & (F.col("missing") == 0)).alias("candidate_key"), (F.col("raw") / F.greatest(F.lit(1), F.col("rows")) > MAJORITY).alias("high_cardinality"))


def composite_keys(df: DataFrame, spec: DatasetSpec, columns: list[str] | None = None, cap: int | None = DUPLICATE_CAP) -> list[tuple[str, str]]:
    """Pairs among the first four columns of high cardinality that are unique over the first rows.

    After two pairs, each further first column may add one more: its partners are tried up to the first that fits.
    """
    keys = key_profile(df, spec, columns).filter("high_cardinality").select("column").collect()
    high = [c for c in (columns or df.columns) if c in {r["column"] for r in keys}][:PAIR_COLUMNS]
    pairs = list(combinations(high, 2))
    if not pairs:
        return []
    head = first_rows(df, spec, cap)
    raw = lambda c: F.coalesce(_text(c), F.lit(""))
    found = head.agg(F.count("*").alias("rows"), *(F.count_distinct(F.struct(raw(a), raw(b))).alias(f"{a}/{b}") for a, b in pairs)).first()
    out: list[tuple[str, str]] = []
    for a in high:
        for b in high[high.index(a) + 1 :]:
            if found["rows"] and found[f"{a}/{b}"] == found["rows"]:
                out.append((a, b))
                if len(out) >= COMPOSITES:
                    break
    return out


def quality_profile(df: DataFrame, spec: DatasetSpec, columns: list[str] | None = None) -> DataFrame:
    """column, whitespace, mixed_types, invalid (values of a numeric column that aren't numbers) of every column."""
    columns = columns or df.columns
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(spec.kind(df, c) == "numeric").alias("numeric"), _text(c).alias("raw"), value_kind(F.col(c)).alias("kind")) for c in columns))
    kinds = sum((F.max((F.col("kind") == k).cast("int")) for k in ("numeric", "date", "string")), F.lit(0))
    by = df.select(F.inline(cells)).groupBy("column").agg(
        F.coalesce(F.bool_or(F.col("raw") != trim_ws(F.col("raw"))), F.lit(False)).alias("whitespace"), F.coalesce(kinds > 1, F.lit(False)).alias("mixed_types"), F.count_if(F.col("numeric") & (F.col("kind") != "numeric")).alias("invalid")
    )
    return _every(by, columns, whitespace=F.lit(False), mixed_types=F.lit(False), invalid=F.lit(0).cast("bigint"))
