"""Deterministic samples of a table's rows, by position in its order.

Positions are only given to rows that a rule can pick: the ends by ordered limits, quantile rows by their rank, rare
categories by their first row.  A table that carries a position column needs no numbering at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.coerce import finite
from quillmark.operators.profile import logical_kind
from quillmark.sources.shared import checkpointed

SEED = "sample-v1"
SAMPLE_N, HEAD_TAIL_MAX, HEAD_TAIL_SHARE, RARE = 200, 15, 0.15, 5
EXACT_MAX, MEDIUM_MAX, MEDIUM_BASE, MEDIUM_DIVISOR, MEDIUM_CAP = 1000, 5000, 400, 10, 1000


def selection(n: int) -> tuple[str, int]:
    """Mode and size of the sample of a table of n rows: exact, or representative."""
    if n <= EXACT_MAX:
        return "exact", n
    return "representative", min(MEDIUM_BASE + n // MEDIUM_DIVISOR, MEDIUM_CAP) if n <= MEDIUM_MAX else SAMPLE_N


def sample_metadata(n: int, sample_n: int = SAMPLE_N) -> dict:
    """What a profile run says of its sample; another rule than selection()."""
    return {"n": min(sample_n, n), "coverage": "exact" if 0 < n <= min(sample_n, EXACT_MAX) else "sample", "method": "stratified"}


def with_position(df: DataFrame, order: list[str | Column], name: str = "_pos") -> DataFrame:
    """Adds 0-based positions in an order without a single task for all: ranges, sorted each, and what lies before each.

    The ranges are computed once and kept, as another run might cut them elsewhere.
    """
    spark, own = df.sparkSession, df.columns
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # The id's upper bits are the range, the lower 33 the place in it.
    ranged = checkpointed(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)
    return ranged.join(F.broadcast(starts), "_range").select(*own, place.cast("bigint").alias(name))


def head_tail(df: DataFrame, pos: str, n: int, sample_n: int) -> DataFrame:
    """Rows at both ends: a seventh or so of the sample, fifteen at most from each end."""
    h = min(HEAD_TAIL_MAX, int(sample_n * HEAD_TAIL_SHARE))
    return df.filter((F.col(pos) < h) | (F.col(pos) >= max(0, n - h)))


def quantile_rows(df: DataFrame, pos: str, column: str, remaining: int) -> DataFrame:
    """Every step-th row in ascending order of a numeric column, of rows that have a finite number there."""
    numbers = df.select(F.col(pos).alias("pos"), finite(F.col(column), logical_kind(df.schema[column].dataType)).alias("v")).filter("v is not null")
    m = numbers.count()
    step = max(1, m // max(1, remaining))
    ranked = with_position(numbers, ["v", "pos"], "rank")
    return ranked.filter(F.col("rank") % step == 0).select("pos", "rank")


def rare_rows(df: DataFrame, pos: str, column: str, k: int = RARE) -> DataFrame:
    """The first row of each of the k least frequent values; null counts as an empty text but has no first row."""
    raw = F.col(column).cast("string")
    by = df.groupBy(F.coalesce(raw, F.lit("")).alias("value")).agg(F.count("*").alias("count"), F.min(F.when(raw.isNotNull(), F.col(pos))).alias("pos"), F.min(pos).alias("seen"))
    return by.orderBy("count", "seen").limit(k).select("value", "count", "pos")


def seed_of(dataset: str, content_hash: str, seed: str = SEED, version: str = "v1") -> str:
    """The text that starts the generator; seed names a series of samples."""
    return hashlib.sha256(f"{dataset}:{content_hash}:{seed}:{version}".encode()).hexdigest()


def lcg(seed: str, n: int) -> Iterator[int]:
    """Positions below n by a linear congruential generator (fixed constants) started from a seed text."""
    s = 0
    for ch in seed:
        s = ((33 * s) & 0xFFFFFFFF) ^ ord(ch)
    while n > 0:
        s = (1664525 * s + 1013904223) & 0xFFFFFFFF
        yield s % n


def sample_positions(df: DataFrame, pos: str, n: int, sample_n: int, seed: str, numeric: str | None = None, categorical: str | None = None) -> list[int]:
    """Positions of a sample in the order they are picked: ends, quantile rows, rare categories, then by generator.

    At most `sample_n` numbers reach the driver, where the sequential rules run.
    """
    sample_n = min(sample_n, n)
    h = min(HEAD_TAIL_MAX, int(sample_n * HEAD_TAIL_SHARE))
    out = dict.fromkeys([*range(min(h, n)), *range(max(0, n - h), n)])
    if numeric and len(out) < sample_n:
        for r in quantile_rows(df, pos, numeric, sample_n - len(out)).orderBy("rank").limit(2 * sample_n).collect():
            if len(out) < sample_n:
                out.setdefault(r["pos"])
    if categorical and len(out) < sample_n:
        for r in rare_rows(df, pos, categorical).collect():
            if r["pos"] is not None and len(out) < sample_n:
                out.setdefault(r["pos"])
    fill = lcg(seed, n)
    while len(out) < sample_n:
        out.setdefault(next(fill))
    return list(out)[:sample_n]


def rows_at(df: DataFrame, pos: str, positions: list[int]) -> DataFrame:
    """The rows at the positions (of a bounded sample), with their place in it."""
    places = df.sparkSession.createDataFrame(list(enumerate(positions)), "place int, _at bigint")
    return df.join(F.broadcast(places), F.col(pos) == F.col("_at")).drop("_at")
