"""Exact top-k inner products by no-random-access aggregation of sorted lists.

Candidates are packed into blocks of about `BLOCK` vectors.  Each block gets one sorted list for each component, once,
before any query is read; blocks and lists are written to the shared folder.  A score is a sum over components, so for a
query the lists are read in step, from the top where its component is positive and from the bottom where it's negative.
What was read of a candidate, with the worst and with the best that its unread components can still add, bounds its score
from below and above.  Reading stops once no candidate outside a few survivors can reach the k-th best lower bound; only
the survivors' scores are then completed, and the k best of each block go on to the merge of all blocks.

Queries come in chunks of at most `CHUNK` bytes, each broadcast to the tasks that hold the blocks, so no query is
shipped once for each block, and candidates don't move at all.  A first pass over a single block gives every query of the
chunk a floor: what can't reach the k-th best score there can't be among the best k.  Later blocks of a task raise it.

Equal vectors of a block are one entry with their smallest ids, so ties, however many, cost nothing.

Components become floor(scale * x) with x as double, scores are integers, ties go to the smaller id.  Rows whose id or
vector is null, or whose vector holds a null or non-finite component, take no part; an empty vector scores 0 with other
empty ones.  Vectors meet only vectors of their own length.  Of several query rows with one id, one is asked: the least
vector; candidates with the query's id are left out.  Integers too large for exact doubles are multiplied as Python
integers and ranked as such; a score beyond 64 bits is returned as the nearest that fits.  Other columns, whatever their
names, aren't read.  An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import release, written

#: Vectors of a block, and its components; bytes of a chunk of queries.
BLOCK, CELLS, CHUNK = 4096, 1 << 18, 32 << 20
#: How far the lists are read before bounds are looked at again, as shares of their length.
STOPS = (0.03, 0.06, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Reading ends once a block's survivors are one in so many: their scores are then completed.
SURVIVORS = 8
PACKED = "width int, ids binary, matrix binary, lists binary"
FOUND = "query_id bigint, vec_id bigint, score bigint, beyond string"
LONG = 2**63 - 1


class Block:
    """The distinct vectors of a block, each with its smallest ids, and a sorted list of entries for each component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, lists: np.ndarray | None = None):
        """x: whole numbers, small enough for exact sums; lists: of sorted_lists(x), if they were made before."""
        order = np.argsort(ids, kind="stable")
        self.x, first, group = _distinct(x[order])
        self.ids: list[list[int]] = [[] for _ in self.x]
        for own, g in zip(ids[order].tolist(), group.tolist(), strict=True):
            if len(self.ids[g]) <= k:  # one more than k: the query's own may be among them
                self.ids[g].append(own)
        self.lists = sorted_lists(self.x) if lists is None else lists
        self.values = np.take_along_axis(self.x.T, self.lists, axis=1)

    def best(self, query: np.ndarray, k: int, floor: float = -math.inf) -> tuple[list[tuple[float, int]], int]:
        """(score, entry) of all entries that may be among the k best, none below floor; and how many list entries were read."""
        n = len(self.x)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        used = np.concatenate([up, down])
        if not len(used):
            return ([(0.0, e) for e in range(n)] if floor <= 0 else []), 0
        weight = query[used]
        worst = weight * np.concatenate([self.values[up, 0], self.values[down, -1]])
        front_at = lambda depth: weight * np.concatenate([self.values[up, n - depth], self.values[down, depth - 1]])
        read, lower, seen, at, taken, alive = np.zeros(n), np.full(n, worst.sum()), np.zeros((len(used), n), np.float32), 0, 0, np.arange(n)
        column = np.arange(len(used))[:, None]
        stops = [min(n, math.ceil(n * share)) for share in STOPS]
        if floor > -math.inf:  # before this depth the lists' own values say that a candidate not shown yet could qualify
            first = bisect.bisect_left(range(1, n), True, key=lambda depth: front_at(depth).sum() < floor) + 1
            stops = [first, *(s for s in stops if s > first)]
        for upto in stops:
            if upto <= at:
                continue
            entries = np.concatenate([self.lists[up, n - upto : n - at], self.lists[down, at:upto]])
            gains = weight[:, None] * np.concatenate([self.values[up, n - upto : n - at], self.values[down, at:upto]])
            flat = entries.ravel()
            read += np.bincount(flat, gains.ravel(), n)
            taken, at = taken + entries.size, upto
            if at == n:
                alive = np.flatnonzero(read >= max(floor, np.partition(read, max(0, n - k))[max(0, n - k)]))
                break
            seen[column, entries] = 1.0
            front, bar = front_at(at), floor
            if floor == -math.inf and n > k:
                lower += np.bincount(flat, (gains - worst[:, None]).ravel(), n)
                bar = np.partition(lower, n - k)[n - k]
            if front.sum() >= bar:
                continue  # a candidate that no list has shown yet could still qualify
            # Single precision is for the mask's product only; what it may round away, a unit for each component summed, is
            # added to the bound.
            slack = max(1e-5, (len(front) + 2) * 2.0**-23) * np.abs(front).sum()
            alive = np.flatnonzero(read + (front.sum() - front.astype(np.float32) @ seen) + slack >= bar)
            if len(alive) <= max(8 * k, n // SURVIVORS):
                break
        scores = self.x[alive] @ query
        return [(s, e) for s, e in zip(scores.tolist(), alive.tolist(), strict=True) if s >= floor], taken


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, in order of their first; where each first is; the number of each row's distinct one."""
    if not x.shape[1]:
        return x[:1], np.zeros(min(1, len(x)), np.int64), np.zeros(len(x), np.int64)
    raw = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()  # + 0.0: no negative zero
    _, first, group = np.unique(raw, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return np.ascontiguousarray(x[first[order]]), first[order], place[group.ravel()]


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """components x entries: the entries of each component's list, least value first."""
    return np.argsort(x.T, axis=1, kind="stable")


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles, or Python integers where one of them is too large for exact doubles."""
    if np.abs(x).max(initial=0) < 2.0**40:
        return np.floor(scale * x)
    return np.array([[math.floor(scale * c) if abs(c) < 2.0**52 else int(c) * scale for c in row] for row in x.tolist()], object).reshape(x.shape)


def _packed(df: DataFrame, k: int, scale: int) -> DataFrame:
    """Blocks of vectors of one length, as doubles, with the sorted lists of their distinct vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for own, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, vectors = waiting.setdefault(len(vector), ([], []))
                ids.append(own)
                vectors.append(vector)
                if len(ids) >= BLOCK or len(ids) * len(vector) >= CELLS:
                    yield row(len(vector), *waiting.pop(len(vector)))
        for width, (ids, vectors) in waiting.items():
            yield row(width, ids, vectors)
        release()

    def row(width: int, ids: list, vectors: list) -> pa.RecordBatch:
        own, x = np.array(ids, "<i8"), np.array(vectors, "<f8").reshape(len(ids), width)
        q = whole(x, scale)
        lists = b"" if q.dtype == object else Block(own, q, k).lists.astype("<u2").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([lists], pa.binary())], names=["width", "ids", "matrix", "lists"])

    return df.mapInArrow(run, PACKED)


def _beyond(score: int) -> str:
    """Orders scores that are the same when cut to 64 bits."""
    if abs(score) <= LONG or score == -LONG - 1:
        return "m"
    digits = str(abs(score))
    key = f"{len(digits):06d}{digits}"
    return f"p{key}" if score > 0 else "a" + "".join(chr(ord("9") - int(c) + ord("0")) for c in key)


Queries = dict[int, tuple[np.ndarray, np.ndarray]]


def _searched(blocks: DataFrame, queries: Broadcast, floors: Broadcast | None, k: int, scale: int, counters: tuple[Accumulator, Accumulator] | None) -> DataFrame:
    """The k best of each block for every query of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, tuple[list[int], np.ndarray]] = {w: (ids.tolist(), whole(x, scale)) for w, (ids, x) in queries.value.items()}
        known: dict[int, list[int]] = {q: [floor] * k for q, floor in floors.value.items()} if floors else {}
        for batch in batches:
            for width, ids, matrix, lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if width not in asked:
                    continue
                (query_ids, q), own_ids = asked[width], np.frombuffer(ids, "<i8")
                x = whole(np.frombuffer(matrix, "<f8").reshape(len(own_ids), width), scale)
                exact = width == 0 or (object not in (x.dtype, q.dtype) and width * max(np.abs(x).max(initial=0), 1) * max(np.abs(q).max(initial=0), 1) < 2**50)
                block = Block(own_ids, x, k, np.frombuffer(lists, "<u2").reshape(width, -1).astype(np.intp) if width else None) if exact else None
                found: list[tuple[int, int, int, str]] = []
                for query_id, query in zip(query_ids, q, strict=True):
                    before = known.get(query_id, [])
                    if block is not None:
                        ranked, taken = block.best(query, k + 1, before[-1] if len(before) == k else -math.inf)
                        if counters:
                            counters[0].add(taken)
                            counters[1].add(block.lists.size)
                        scored = [(int(s), v) for s, e in ranked for v in block.ids[e] if v != query_id]
                    else:
                        weights = [int(c) for c in query]
                        scored = [(sum(int(a) * b for a, b in zip(row, weights, strict=True)), v) for row, v in zip(x, own_ids.tolist(), strict=True) if v != query_id]
                    scored = sorted(scored, key=lambda s: (-s[0], s[1]))[:k]
                    known[query_id] = sorted(before + [s for s, _ in scored], reverse=True)[:k]
                    found += [(query_id, v, max(-LONG - 1, min(LONG, s)), _beyond(s)) for s, v in scored]
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["query_id", "vec_id", "score", "beyond"])
        release()

    return blocks.select("width", "ids", "matrix", "lists").mapInArrow(run, FOUND)


def _chunks(rows: Iterator) -> Iterator[Queries]:
    """Queries by their length, as they come, cut to CHUNK bytes."""
    waiting: dict[int, list] = {}
    size = 0
    for r in rows:
        waiting.setdefault(len(r["q"]), []).append(r)
        size += 8 * len(r["q"]) + 100
        if size >= CHUNK:
            yield _as_arrays(waiting)
            waiting, size = {}, 0
    if waiting:
        yield _as_arrays(waiting)


def _as_arrays(waiting: dict[int, list]) -> Queries:
    return {w: (np.array([r["vec_id"] for r in rows], np.int64), np.array([r["q"] for r in rows], np.float64).reshape(len(rows), w)) for w, rows in waiting.items()}


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", counters: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query; fewer if there are fewer.

    counters: of list entries read, and of all entries of the lists of each query and block.
    """
    spark = df.sparkSession
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    own = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(~bad, vector.cast("array<double>")).alias("q"), is_query.alias("asked")).filter("vec_id is not null and q is not null")
    size = own.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.sum(F.size("q") * 8 + 100).alias("bytes")).first()
    parts = max(1, -(-size["n"] // BLOCK), -(-(size["bytes"] or 0) // (8 * CELLS)))
    blocks = written(_packed(own.select("vec_id", "q").repartition(parts), k, scale), "blocks")
    asked = own.filter("asked").groupBy("vec_id").agg(F.min("q").alias("q"))
    asked = written(asked.repartition(max(1, -(-size["asked"] * (size["bytes"] or 0) // (max(1, size["n"]) * CHUNK)))), "queries")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    # The one block that gives floors: a bounded sample of candidates, all of which are met again.
    first = written(blocks.limit(1), "blocks") if parts > 2 else None
    done = [spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")]
    for chunk in _chunks(asked.toLocalIterator()):
        queries, floors = spark.sparkContext.broadcast(chunk), None
        if first is not None:
            rows = _searched(first, queries, None, k, scale, None).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor"), F.max(F.col("beyond") != "m").alias("beyond"))
            floors = spark.sparkContext.broadcast({r["query_id"]: r["floor"] for r in rows.filter((F.col("n") >= k) & ~F.col("beyond")).collect()})
        found = _searched(blocks, queries, floors, k, scale, counters).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        done.append(written(found.select("query_id", "rank", "vec_id", "score"), "best"))
        for sent in filter(None, (queries, floors)):
            sent.destroy()
    out = done[-1] if len(done) == 2 else done[0]
    for more in done[1:] if len(done) > 2 else []:
        out = out.unionByName(more)
    return out
