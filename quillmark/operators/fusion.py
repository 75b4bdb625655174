"""Ranks, reciprocal rank fusion, and context boosts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators.sampling import with_position
from quillmark.sources.shared import checkpointed

RRF_K = 60
#: Queries up to which what is known of each is broadcast: two lists of some hundred scores and positions each.
BROADCAST_QUERIES = 2_000
#: What is added to a fused score.
BOOSTS = {"active": 0.15, "stale": 0.05, "superseded": -0.10, "dataset": 0.2, "cell": 0.3, "column": 0.2, "near_cell": 0.15, "near_source": 0.10}


def rank_by(score: str, pos: str, query: str) -> Column:
    """1-based rank within each query, best first, ties by position."""
    return F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc_nulls_last(), pos))


def ranked(df: DataFrame, score: str, pos: str, name: str = "rank", query: str | None = None) -> DataFrame:
    """Adds the rank, best first, ties by position; within each query, or of all rows, by ranges instead of in one task."""
    if query:
        return df.withColumn(name, rank_by(score, pos, query))
    placed = with_position(df, [F.col(score).desc_nulls_last(), F.col(pos)], name)
    return placed.withColumn(name, F.col(name) + 1)


def fused(df: DataFrame, scores: Sequence[str], pos: str, query: str | None = None, k: int = RRF_K) -> DataFrame:
    """Adds rrf: the sum of 1 / (k + rank) over the scores.  Every row has a rank in each, also with score zero."""
    total = F.lit(0.0)
    for s in scores:
        df = ranked(df, s, pos, f"_rank_{s}", query)
        total = total + 1.0 / (k + F.col(f"_rank_{s}"))
    return df.withColumn("rrf", total).drop(*(f"_rank_{s}" for s in scores))


def pool(df: DataFrame, scores: Sequence[str], pos: str, size: int | Column, raised: Column | None = None, query: str | None = None, k: int = RRF_K, first: int = 64) -> DataFrame:
    """The `size` best rows of each query by fused score plus `raised`, with rrf and score: those of fused(), without ranking all rows.

    Only rows that lead a list among rows raised alike can be among the best: `first` of each list are taken, and their
    exact ranks counted, as the rows that come before each.  A row that wasn't taken ranks behind the last one taken in every
    list; if that leaves it no chance against the rows found, the query is done, else it is asked again with four times as
    many.  df is read twice a turn; what is shuffled is the rows taken in each task, and their counts.  `raised` should have
    few values.  Scores are summed as they come, so df must give the same ones each time.  Null scores come last.
    """
    by = [query] if query else ["_all"]
    rows = df if query else df.withColumn("_all", F.lit(0))
    rows = rows.withColumns({"_raised": F.lit(0.0) if raised is None else raised.cast("double"), "_size": F.lit(size) if isinstance(size, int) else size, **{f"_at_{s}": place_in(s, pos) for s in scores}})

    def asked(again: DataFrame | None) -> DataFrame:
        return rows if again is None else rows.join(F.broadcast(again) if again.count() <= BROADCAST_QUERIES else again, by, "left_semi")

    def lead(first: int, again: DataFrame | None) -> DataFrame:
        taken = None
        for s in scores:
            ahead = F.row_number().over(Window.partitionBy(*by, "_raised").orderBy(F.desc(f"_at_{s}.s"), f"_at_{s}.o"))
            led = asked(again).withColumn("_lead", ahead).filter(F.col("_lead") <= first).drop("_lead")
            taken = led if taken is None else taken.unionByName(led)
        return taken

    def count(taken: DataFrame, again: DataFrame | None) -> DataFrame:
        # Of each query the rows taken, best first in each list, and how many rows lie between one and the next.
        better = lambda x, y: (x["s"] > y["s"]) | ((x["s"] == y["s"]) & (x["o"] < y["o"]))
        sort = lambda s: F.array_sort(F.collect_list(f"_at_{s}"), lambda x, y: F.when(better(x, y), -1).when(better(y, x), 1).otherwise(0))
        marks = taken.groupBy(*by).agg(*(sort(s).alias(f"_marks_{s}") for s in scores))
        placed = asked(again).join(F.broadcast(marks) if marks.count() <= BROADCAST_QUERIES else marks, by)
        behind = lambda s: F.size(F.filter(f"_marks_{s}", lambda m: better(m, F.col(f"_at_{s}"))))
        return placed.select(*by, F.posexplode(F.array(*map(behind, scores))).alias("_list", "_behind")).groupBy(*by, "_list", "_behind").agg(F.count("*").alias("_n"))

    return settled(lead, count, df.columns, scores, pos, by, k, first)


def place_in(score: str, pos: str) -> Column:
    """Where a row stands in a list: its score, null as the least, and its position."""
    return F.struct(F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("s"), F.col(pos).alias("o"))


def settled(lead: Callable[[int, DataFrame | None], DataFrame], count: Callable[[DataFrame, DataFrame | None], DataFrame], own: Sequence[str], scores: Sequence[str], pos: str, by: list[str], k: int = RRF_K, first: int = 64) -> DataFrame:
    """pool() over rows that lead() and count() know, wherever they are made; both take the queries asked again, None for all.

    lead: at least the `first` rows of each query and list among rows raised alike, with _raised, _size and _at_ of each
    list (place_in).  count, of such rows: by, _list, _behind, _n, how many rows of the query have so many of these before them.
    """
    again, done = None, None
    while True:
        taken = checkpointed(lead(first, again).dropDuplicates([*by, pos]))
        counts = count(taken, again)
        ranks = checkpointed(counts.withColumn("_rank", F.sum("_n").over(Window.partitionBy(*by, "_list").orderBy("_behind"))))
        found = taken
        total = F.lit(0.0)
        for j, s in enumerate(scores):
            mine = ranks.filter(F.col("_list") == j).select(*by, F.col("_behind").alias(f"_b{j}"), F.col("_rank").alias(f"_rank_{s}"))
            before = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(f"_at_{s}.s"), f"_at_{s}.o")) - 1
            found = found.withColumn(f"_b{j}", before).join(mine, [*by, f"_b{j}"])
            total = total + 1.0 / (k + F.col(f"_rank_{s}"))
        found = found.withColumn("rrf", total).withColumn("score", total + F.col("_raised"))
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), pos))
        found = checkpointed(found.withColumn("_place", place).select(*dict.fromkeys([*own, *by]), "rrf", "score", "_place", "_size", "_raised", *(f"_rank_{s}" for s in scores)))
        # What a row that wasn't taken can have at most, by how it is raised; where fewer were taken, none is left.
        last = [F.coalesce(F.max(F.when(F.col(f"_lead_{s}") == first, F.col(f"_rank_{s}"))), F.lit(None)).alias(f"_last_{s}") for s in scores]
        leads = {f"_lead_{s}": F.row_number().over(Window.partitionBy(*by, "_raised").orderBy(f"_rank_{s}")) for s in scores}
        chance = found.withColumns(leads).groupBy(*by, "_raised").agg(*last).filter(F.col(f"_last_{scores[0]}").isNotNull())
        most = chance.groupBy(*by).agg(F.max(F.col("_raised") + sum((1.0 / (k + 1 + F.col(f"_last_{s}")) for s in scores), F.lit(0.0))).alias("_most"))
        worst = found.filter(F.col("_place") <= F.col("_size")).groupBy(*by).agg(F.min("score").alias("_worst"), F.count("*").alias("_n"), F.first("_size").alias("_size"))
        again = checkpointed(worst.join(most, by).filter((F.col("_n") < F.col("_size")) | (F.col("_most") >= F.col("_worst") - 1e-12)).select(*by))
        best = found.filter(F.col("_place") <= F.col("_size")).join(again, by, "left_anti").select(*own, "rrf", "score")
        done = best if done is None else done.unionByName(best)
        if again.isEmpty():
            return done
        first = 4 * first


def boost(status: Column, in_dataset: Column | None = None, own_cell: Column | None = None, source_cell: Column | None = None, in_column: Column | None = None, distance: Column | None = None, source_distance: Column | None = None) -> Column:
    """The sum of all boosts that apply.  A record of the active cell counts twice: by its own cell and by its source."""
    yes = lambda c, name: F.when(F.coalesce(c, F.lit(False)), BOOSTS[name]).otherwise(0.0) if c is not None else F.lit(0.0)
    near = lambda d, name: F.coalesce(BOOSTS[name] / (1 + F.abs(d)), F.lit(0.0)) if d is not None else F.lit(0.0)
    by_status = F.when(status == "active", BOOSTS["active"]).when(status == "stale", BOOSTS["stale"]).when(status == "superseded", BOOSTS["superseded"]).otherwise(0.0)
    return by_status + yes(in_dataset, "dataset") + yes(own_cell, "cell") + yes(source_cell, "cell") + yes(in_column, "column") + near(distance, "near_cell") + near(source_distance, "near_source")
