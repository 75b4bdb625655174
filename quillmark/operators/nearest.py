"""Exact nearest vectors by cosine for many queries: products of whole batches, exact scores for what can be among the best.

Queries go out in chunks of bounded bytes, and vectors stay where they lie: each task multiplies its Arrow batches with the
chunk and keeps k rows for each query, so that only these are shuffled.  A product of matrices sums in an order of its own,
so it only chooses candidates, with a slack far above its rounding; their scores are then summed component by component,
as functions.vectors.cosine does, and are equal to its.  Of equal vectors of a batch the k smallest keys stand for all.
Memory is bounded by a batch and a chunk; of each pair of a vector and a query nothing but its product is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk of queries; scores of a product that are held at once; rows of a batch that are multiplied at once.
CHUNK, CELLS, ROWS = 32 << 20, 1 << 21, 8192
#: What a product of unit vectors may differ from the exact cosine, for each component.
SLACK = 1e-13
#: Kinds of vectors: with a null, without a direction, with NaN or infinity, too large or small for plain products, any other.
NULL, ZERO, NAN, FAR, PLAIN = range(5)


class Vectors:
    """Vectors of one width with their keys: exact norms, kinds, and unit vectors for products."""

    def __init__(self, keys: np.ndarray, x: np.ndarray, null: np.ndarray):
        self.keys, self.x = keys, x
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(_summed(x * x))
            self.kind = np.select([null, ~np.isfinite(x).all(axis=1), self.norm == 0, (self.norm < 1e-100) | (self.norm > 1e100)], [NULL, NAN, ZERO, FAR], PLAIN)
            self.unit = np.where((self.kind == PLAIN)[:, None], x / self.norm[:, None], 0.0)

    def taken(self, at: np.ndarray) -> Vectors:
        out = object.__new__(Vectors)
        out.keys, out.x, out.norm, out.kind, out.unit = self.keys[at], self.x[at], self.norm[at], self.kind[at], self.unit[at]
        return out


def _summed(products: np.ndarray) -> np.ndarray:
    """Sums of rows from the first component on."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def scores(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """functions.vectors.cosine of pairs; without one minus infinity, and infinity for NaN, as they rank."""
    out = np.empty(len(i))
    step = max(1, CELLS // max(1, a.x.shape[1]))
    for s in range(0, len(i), step):
        m, n = i[s : s + step], j[s : s + step]
        with np.errstate(all="ignore"):
            size = a.norm[m] * b.norm[n]
            found = _summed(a.x[m] * b.x[n]) / size
        found = np.where(np.isnan(found), np.inf, found)
        out[s : s + step] = np.where((a.kind[m] == NULL) | (b.kind[n] == NULL) | (size == 0), -np.inf, found)
    return out


def _ordered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].ravel() if keys.dtype == object else keys


class Best:
    """The k best keys and scores so far of the queries of one width."""

    def __init__(self, asked: Vectors, k: int):
        self.asked, self.k = asked, k
        self.query, self.score, self.keys = np.empty(0, np.int64), np.empty(0), None
        self.last = np.full(len(asked.keys), -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, keys: np.ndarray) -> None:
        if self.keys is not None:
            query, score, keys = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.keys, keys])
        order = np.lexsort((_ordered(keys), -score, query))
        query, score, keys = query[order], score[order], keys[order]
        start = np.searchsorted(query, np.arange(len(self.last)))
        place = np.arange(len(query)) - start[query]
        kept = place < self.k
        self.last[query[place == self.k - 1]] = score[place == self.k - 1]
        self.query, self.score, self.keys = query[kept], score[kept], keys[kept]

    def look(self, rows: Vectors, queries: np.ndarray) -> None:
        """Takes in rows that these queries (numbers) meet."""
        rows, asked, k = _spared(rows, self.k), self.asked, self.k
        plain = np.flatnonzero(rows.kind == PLAIN)
        rest = np.flatnonzero(rows.kind != PLAIN)
        # A query without a direction scores all rows of a kind alike: their smallest keys are enough.
        some = np.concatenate([rest, plain[np.argsort(_ordered(rows.keys[plain]), kind="stable")[:k]]])
        for number, at in ((queries[np.isin(asked.kind[queries], (NULL, ZERO, NAN))], some), (queries[asked.kind[queries] == FAR], np.arange(len(rows.keys))), (queries[asked.kind[queries] == PLAIN], rest)):
            if len(at):
                step = max(1, CELLS // len(at))
                for s in range(0, len(number), step):
                    q = np.repeat(number[s : s + step], len(at))
                    r = np.tile(at, len(number[s : s + step]))
                    self.add(q, scores(asked, q, rows, r), rows.keys[r])
        number, unit, slack = queries[asked.kind[queries] == PLAIN], rows.unit[plain].T, SLACK * (rows.x.shape[1] + 8)
        step = max(1, CELLS // max(1, len(plain)))
        for s in range(0, len(number) if len(plain) else 0, step):
            some = number[s : s + step]
            product = asked.unit[some] @ unit
            bar = self.last[some] - slack
            many = np.flatnonzero((product >= bar[:, None]).sum(axis=1) > 4 * k) if len(plain) > 4 * k else []
            if len(many):
                bar[many] = np.maximum(bar[many], np.partition(product[many], len(plain) - k, axis=1)[:, len(plain) - k] - 2 * slack)
            q, r = np.nonzero(product >= bar[:, None])
            if len(q):
                self.add(some[q], scores(asked, some[q], rows, plain[r]), rows.keys[plain[r]])


def _spared(rows: Vectors, k: int) -> Vectors:
    """Without rows that k others of smaller keys score as: equal vectors, and those of a kind without a direction."""
    raw = np.ascontiguousarray(np.where((rows.kind >= FAR)[:, None], rows.x, rows.kind[:, None]) + 0.0)
    group = np.zeros(len(raw), np.int64)
    if raw.shape[1]:
        group = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    group = group * (PLAIN + 1) + rows.kind
    order = np.lexsort((_ordered(rows.keys), group))
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return rows.taken(np.sort(order[place < k]))


def by_width(keys: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, Vectors]]:
    """Rows with a vector, by its width: their numbers, and the vectors."""
    size = pa.compute.fill_null(pa.compute.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for width in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == width)
        flat = vectors.take(pa.array(at)).flatten()
        null = pa.compute.is_null(flat).to_numpy(zero_copy_only=False).reshape(len(at), width).any(axis=1)
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
        yield at, Vectors(keys.take(pa.array(at)).to_numpy(zero_copy_only=False), x, null)


def chunks(queries: DataFrame, at_once: int) -> Iterator[pa.Table]:
    """Queries (query_id, query) with a vector, as they come, at most so many and CHUNK bytes at a time; of each its rows as Arrow."""
    rows, size = [], 0
    kinds = {c: queries.schema[c].dataType for c in ("query_id", "query")}
    for r in queries.select(*kinds).filter("query is not null").toLocalIterator():
        rows.append(r)
        size += 8 * len(r["query"]) + 100
        if len(rows) >= at_once or size >= CHUNK:
            yield _table(rows, kinds)
            rows, size = [], 0
    if rows:
        yield _table(rows, kinds)


def _table(rows: list, kinds: dict) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.table({c: pa.array([r[c] for r in rows], to_arrow_type(t)) for c, t in kinds.items()})


def nearest(rows: DataFrame, asked: Broadcast, k: int, vector: str, key: str, cell: str | None = None, meets: Callable[[int, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """query_id, key, score: of each task the k best rows for each query of the chunk (a table: query_id, query).

    cell, meets: a column by which rows are told apart, and which queries (numbers in the chunk, vectors) meet rows of a cell.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = asked.value.combine_chunks()
        ids = table.column("query_id").combine_chunks()
        best = {v.x.shape[1]: (at, Best(v, k)) for at, v in by_width(pa.array(range(len(ids))), table.column("query").combine_chunks())}
        met: dict[tuple[int, int], np.ndarray] = {}
        key_type = None
        for whole in batches:
            key_type = whole.column(0).type
            for s in range(0, whole.num_rows, ROWS):
                b = whole.slice(s, ROWS)
                cells = b.column(2).to_numpy(zero_copy_only=False) if cell else np.zeros(b.num_rows, np.int64)
                for at, v in by_width(b.column(0), b.column(1)):
                    width = v.x.shape[1]
                    if width not in best:
                        continue
                    numbers, found = best[width]
                    for c in np.unique(cells[at]).tolist():
                        if (width, c) not in met:
                            met[width, c] = np.flatnonzero(meets(c, numbers, found.asked.x)) if meets else np.arange(len(numbers))
                        if len(met[width, c]):
                            found.look(v.taken(np.flatnonzero(cells[at] == c)), met[width, c])
        for numbers, found in best.values():
            if found.keys is not None and len(found.keys):
                score = np.where(np.isposinf(found.score), np.nan, found.score)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(numbers[found.query])), pa.array(found.keys, key_type), pa.array(score, pa.float64(), mask=np.isneginf(score))], names=["query_id", key, "score"])

    columns = [F.col(key), F.col(vector), *([F.col(cell)] if cell else [])]
    return rows.select(*columns).mapInArrow(run, f"query_id {_query_type(asked)}, `{key}` {kind}, score double")


def _query_type(asked: Broadcast) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(asked.value.schema.field("query_id").type).simpleString()
