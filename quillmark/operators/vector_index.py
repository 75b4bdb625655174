"""Exact cosine search that doesn't read what can't be near: vectors laid out by pivots, bounded by angles.

Each vector lies with the pivot nearest to it by angle; of a pivot the largest angle to its vectors is known.  Angles keep
the triangle inequality, so no vector of a pivot is nearer to a query than the query's angle to the pivot less that
radius.  A query first looks at the pivots of its best bounds, until they hold k vectors; of the others only those whose
bound reaches the k-th score found.  The layout is a partition column, which a join on it prunes before files are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators import nearest
from quillmark.sources.shared import checkpointed

PIVOTS = 64
#: Added to radii, in radians, and to bounds, against rounding.
SLACK = 1e-6
#: The pivot of vectors without a direction, which rank last.
NOWHERE = -1
#: Queries of a chunk.
QUERIES_AT_ONCE = 10_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between rows of v and unit vectors."""
    with np.errstate(invalid="ignore"):
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return np.arccos(np.clip(v / np.where(length > 0, length, 1.0) @ pivots.T, -1.0, 1.0))


@dataclass
class VectorIndex:
    """Vectors of one width by pivot.  pivots: unit vectors; about: radius and number of vectors of each pivot."""

    rows: DataFrame | None
    pivots: np.ndarray
    about: dict[int, tuple[float, int]]
    key: str
    vector: str
    width: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str, width: int, pivots: int = PIVOTS, vector: str = "embedding", key: str = "vec_id") -> VectorIndex:
        """Writes the vectors of this width, by pivot, to path.  Pivots are vectors of the least hashes, a bounded number."""
        whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        rows = vectors.select(key, vector).filter((F.size(vector) == width) & whole)
        some = rows.filter(F.exists(vector, lambda x: x != 0)).orderBy(F.xxhash64(vector), key).limit(pivots).collect()
        centers = np.array([r[vector] for r in some], np.float64).reshape(-1, width)
        centers /= np.linalg.norm(centers, axis=1, keepdims=True)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = _matrix(b.column(1), width)
                    angle = _angles(v, centers) if len(centers) else np.zeros((len(v), 1))
                    nearest = np.where((v != 0).any(axis=1), angle.argmin(axis=1), NOWHERE)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest, pa.int32()), pa.array(angle.min(axis=1))], names=[key, vector, "pivot", "angle"])

        kinds = dict(rows.dtypes)
        made = rows.mapInArrow(assign, f"`{key}` {kinds[key]}, `{vector}` {kinds[vector]}, pivot int, angle double")
        made.repartition("pivot", F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy("pivot").parquet(path)
        stored = vectors.sparkSession.read.schema(f"`{key}` {kinds[key]}, `{vector}` {kinds[vector]}, angle double, pivot int").parquet(path)
        about = {r["pivot"]: (r["radius"] + SLACK, r["n"]) for r in stored.groupBy("pivot").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()}
        return cls(stored, centers, about, key, vector, width)

    def reaches(self, q: np.ndarray, k: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Pivots; what each query (a row) can find with each of them at most, and whether it looks there first."""
        own = sorted(self.about)
        near = [p for p in own if p != NOWHERE]
        bound = np.full((len(q), len(own)), -2.0)
        if near:
            angle = _angles(q, self.pivots[near]) - np.array([self.about[p][0] for p in near])
            bound[:, [own.index(p) for p in near]] = np.cos(np.maximum(angle, 0.0)) + SLACK
        bound[(q == 0).all(axis=1) | ~np.isfinite(q).all(axis=1)] = -2.0
        n = np.array([self.about[p][1] for p in own], np.int64)
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        return own, bound, first

    def search(self, queries: DataFrame, k: int = 5, at_once: int = QUERIES_AT_ONCE) -> tuple[DataFrame, DataFrame]:
        """query_id, key, score, place of the k nearest by cosine, ties by key, as a search of all vectors gives them; and
        query_id, n: how many vectors each query met.  Queries (query_id, query) go out in chunks."""
        spark, width = self.rows.sparkSession, self.width
        plan = VectorIndex(None, self.pivots, self.about, self.key, self.vector, width)  # without the table, for tasks
        kind = dict(queries.dtypes)["query_id"]
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), self.key)
        ranked = lambda rows: rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
        out = spark.createDataFrame([], f"query_id {kind}, `{self.key}` {dict(self.rows.dtypes)[self.key]}, score double, place int")
        met = spark.createDataFrame([], f"query_id {kind}, n bigint")
        for chunk in nearest.chunks(queries.filter(F.size("query") == width), at_once) if self.about else ():
            asked, q = spark.sparkContext.broadcast(chunk), _matrix(chunk.column("query").combine_chunks(), width)
            own, bound, first = self.reaches(q, k)

            memo: dict = {}

            def top(last: np.ndarray | None, asked=asked, own=own, bound=bound, first=first, memo=memo) -> DataFrame:
                reached = first if last is None else ~first & (bound >= last[:, None])

                def meets(pivot: int, numbers: np.ndarray, x: np.ndarray) -> np.ndarray:
                    if not memo:  # once for each task
                        memo[0] = plan.reaches(x, k)
                    pivots, most, before = memo[0]
                    at = pivots.index(pivot)
                    return before[:, at] if last is None else ~before[:, at] & (most[:, at] >= last[numbers])

                rows = self.rows.filter(F.col("pivot").isin([p for p, some in zip(own, reached.any(axis=0), strict=True) if some]))
                return nearest.nearest(rows, asked, k, self.vector, self.key, "pivot", meets)

            found = checkpointed(ranked(top(None)))
            known = {r["query_id"]: r["last"] for r in found.groupBy("query_id").agg(F.when((F.count("score") == k) & ~F.isnan(F.max("score")), F.min("score")).alias("last")).collect()}
            last = np.array([-3.0 if known.get(i) is None else known[i] for i in chunk.column("query_id").to_pylist()])
            both = checkpointed(ranked(found.drop("place").unionByName(top(last))))
            asked.destroy()
            n = (first | (bound >= last[:, None])) @ np.array([self.about[p][1] for p in own], np.int64)
            out, met = out.unionByName(both), met.unionByName(spark.createDataFrame(list(zip(chunk.column("query_id").to_pylist(), n.tolist(), strict=True)), met.schema))
        return out, met
