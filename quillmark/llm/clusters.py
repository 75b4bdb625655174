"""Exact centroid clustering whose rounds skip distances by bounds kept for groups of centroids.

Components are scaled to whole numbers and centroids are whole too, so every distance, sum and tie is exact.  The first
assignment measures all distances.  After that each vector keeps its cluster, an upper bound of the distance to it, and
one lower bound for each group of centroids (grouped once, by clustering the first centroids) of the distance to all
others in the group.  When centroids move, the upper bound grows by its own centroid's move and the lower bounds shrink
by the largest move in their group.  A vector whose upper bound is below all lower bounds stays; else its own distance is
measured and it is asked again; else the groups whose bound isn't above it are measured in full, and only those.  Bounds
are widened by more than rounding can take, and only strictly lower ones decide, so ties reach the exact comparison.

The vectors' state is a table in the shared folder, rewritten each round; the one before is deleted.  Sums follow the
vectors that changed their cluster: a task adds up what left and what came, one row for a cluster, and the driver gets
clusters x components numbers.  Centroids go out with the tasks; both are bounded by the parameters, not by the data.

Vectors of another length, null ones and those with null or non-finite components take no part.  Rows without an id are
clustered but start no centroid; rows that repeat one are rows of their own, and start by their components' order.  With
fewer vectors than clusters, each starts one; with no vector that has an id, there is no cluster and no row.  Components of 2^27 or more in size once scaled have distances that a long
can't hold, and raise an error.  Other columns aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import small_batches, stored, written

#: Scaled components below this, in size, have distances in a long.
MOST = 1 << 27
#: What bounds are widened by, as a share and as such, to be safe from rounding.
SHARE, SLACK = 1e-9, 1e-6
#: Stands for a distance that wasn't measured; its root is above any that can be.
FAR = np.iinfo(np.int64).max
STATE = "vec_id bigint, x array<double>, was int, cluster int, upper double, lower array<double>, measured bigint"


def vectors(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """vec_id, x of the vectors that take part."""
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.filter((F.size("x") == dims) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))


def whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The scaled components: whole numbers, as doubles."""
    v = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
    most = np.abs(v).max(initial=0)
    if most >= MOST:
        raise ArithmeticError(f"a component of {most:.4g} once scaled: distances of such vectors aren't whole numbers of 64 bits")
    return v


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v to all of c: in doubles where these are exact, which multiply faster."""
    most = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0))
    kind = np.float64 if 4 * v.shape[1] * float(most) ** 2 < 2**53 else np.int64
    v, c = v.astype(kind, copy=False), c.astype(kind, copy=False)
    return ((v * v).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (v @ c.T)).astype(np.int64)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few rounds of clustering them among themselves."""
    c = centroids.astype(np.float64)
    middle = c[np.linspace(0, len(c) - 1, groups).astype(int)]
    for _ in range(5):
        of = ((c[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.stack([c[of == g].mean(axis=0) if (of == g).any() else middle[g] for g in range(groups)])
    return np.unique(of, return_inverse=True)[1]


def least_others(d: np.ndarray, best: np.ndarray, group: np.ndarray) -> np.ndarray:
    """By group, the lower bound of the distance to a centroid that isn't the row's own; beyond all where none was measured."""
    roots = np.sqrt(d.astype(np.float64))
    roots[np.arange(len(d)), best] = np.inf
    return np.stack([roots[:, group == g].min(axis=1) for g in range(group.max() + 1)], axis=1) * (1 - SHARE) - SLACK


def _batch(ids: pa.Array, x: pa.Array, was: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, measured: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(0, lower.size + 1, lower.shape[1], dtype=np.int32))
    bounds = pa.ListArray.from_arrays(ends, pa.array(lower.ravel()))
    return pa.RecordBatch.from_arrays([ids, x, pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), bounds, pa.array(measured, pa.int64())], names=["vec_id", "x", "was", "cluster", "upper", "lower", "measured"])


def first_assignment(centroids: np.ndarray, group: np.ndarray, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(whole(b.column(1), centroids.shape[1], scale), centroids)
                best = d.argmin(axis=1)
                upper = np.sqrt(d[np.arange(len(d)), best].astype(np.float64)) * (1 + SHARE) + SLACK
                yield _batch(b.column(0), b.column(1), np.full(len(d), -1), best, upper, least_others(d, best, group), np.full(len(d), len(centroids)))

    return run


def next_assignment(centroids: np.ndarray, moves: np.ndarray, group: np.ndarray, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """moves: how far each centroid has gone since the last assignment."""
    most_moved = np.array([moves[group == g].max() for g in range(group.max() + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(3).to_numpy().copy()
            upper = (b.column(4).to_numpy() + moves[own]) * (1 + SHARE) + SLACK
            lower = (b.column(5).flatten().to_numpy().reshape(len(own), -1) - most_moved) * (1 - SHARE) - SLACK
            measured, cluster = b.column(6).to_numpy().copy(), own.copy()
            rows = np.flatnonzero(upper >= lower.min(axis=1))
            if len(rows):
                v = whole(b.column(1), centroids.shape[1], scale)
                exact = ((v[rows] - centroids[own[rows]]).astype(np.int64) ** 2).sum(axis=1)
                upper[rows] = np.sqrt(exact.astype(np.float64)) * (1 + SHARE) + SLACK
                measured[rows] += 1
                still = upper[rows] >= lower[rows].min(axis=1)
                rows, exact = rows[still], exact[still]
            if len(rows):
                near = np.full((len(rows), len(centroids)), FAR)
                near[np.arange(len(rows)), own[rows]] = exact
                asked = upper[rows, None] >= lower[rows]
                for g in range(asked.shape[1]):
                    hit, members = np.flatnonzero(asked[:, g]), np.flatnonzero(group == g)
                    near[np.ix_(hit, members)] = distances(v[rows[hit]], centroids[members])
                    measured[rows[hit]] += len(members)
                best = near.argmin(axis=1)
                cluster[rows] = best
                upper[rows] = np.sqrt(near[np.arange(len(rows)), best].astype(np.float64)) * (1 + SHARE) + SLACK
                # A group that was measured has new bounds; one that wasn't keeps its own, but for the centroid just left.
                others = least_others(near, best, group)
                lower[rows] = np.where(asked, others, np.minimum(lower[rows], others))
            yield _batch(b.column(0), b.column(1), own, cluster, upper, lower, measured)

    return run


def moved_sums(state: DataFrame, dims: int, scale: int) -> list:
    """cluster, place, total, n: what vectors that changed their cluster add to and take from sums and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = whole(b.column(0), dims, scale).astype(np.int64)
            for sign, of in ((-1, b.column(1).to_numpy()), (1, b.column(2).to_numpy())):
                for k in np.unique(of[of >= 0]):
                    mine = v[of == k]  # of 2^27 each: a batch of rows is far from what a long holds
                    sums.setdefault(int(k), [0] * (dims + 1))
                    sums[int(k)] = [a + sign * int(x) for a, x in zip(sums[int(k)], [*mine.sum(axis=0), len(mine)], strict=True)]
        if sums:
            flat = [(k, place, total) for k, row in sums.items() for place, total in enumerate(row)]
            k, place, total = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(place, pa.int32()), pa.array(total, pa.int64())], names=["cluster", "place", "total"])

    changed = state.filter("was != cluster").select("x", "was", "cluster")
    parts = changed.mapInArrow(run, "cluster int, place int, total bigint")
    return parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared, exact), measured (distances that were measured for this row); the centroids.

    The k vectors of the least SHA-256 of salt and id start the centroids; each round assigns and replaces them by the
    floor of their vectors' mean; then vectors are assigned once more.
    """
    small_batches(df.sparkSession)
    rows = vectors(df, id_col, vector_col, dims)
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    seeds = rows.filter("vec_id is not null").select(order.alias("order"), "x").orderBy("order", "x").limit(k).collect()
    if not seeds:  # no vector has an id: none starts
        return df.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint, measured bigint"), np.zeros((0, dims), np.int64)
    centroids = whole(pa.array([r["x"] for r in seeds], pa.list_(pa.float64())), dims, scale).astype(np.int64)
    group = grouped(centroids, max(1, round(len(centroids) / 10)))
    state, drop = stored(rows.mapInArrow(first_assignment(centroids, group, scale), STATE), "clusters")
    totals = np.zeros((len(centroids), dims + 1), object)
    for _ in range(rounds):
        for r in moved_sums(state, dims, scale):
            totals[r["cluster"], r["place"]] += int(r["total"])
        after = np.array([[int(t) // int(row[-1]) for t in row[:-1]] if row[-1] else list(c) for row, c in zip(totals, centroids, strict=True)], np.int64)
        if (after == centroids).all():
            break
        moves = np.sqrt(((after - centroids).astype(np.float64) ** 2).sum(axis=1)) * (1 + SHARE) + SLACK
        centroids, before = after, drop
        state, drop = stored(state.mapInArrow(next_assignment(centroids, moves, group, scale), STATE), "clusters")
        before()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                off = whole(b.column(1), dims, scale).astype(np.int64) - centroids[b.column(2).to_numpy()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array((off * off).sum(axis=1)), b.column(3)], names=["vec_id", "cluster", "distance", "measured"])

    return state.select("vec_id", "x", "cluster", "measured").mapInArrow(measure, "vec_id bigint, cluster int, distance bigint, measured bigint"), centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256; clusters are as many rows as there are centroids at most."""
    assigned = written(assigned, "assigned")
    sums = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    known = [(k, total, sum(sums.values()), digest(centroids[k])) for k, total in sums.items()]
    about = assigned.sparkSession.createDataFrame(known, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "measured", "cluster_inertia", "inertia", "centroid_sha256")
