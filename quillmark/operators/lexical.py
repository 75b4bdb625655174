"""Lexical scores: BM25 over whatever candidates a filter leaves, and keyword prefilters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmark.functions.text import tokenize, tokens_of

K1, B = 1.2, 0.75
#: Queries that are broadcast together; queries and texts of one product.
QUERIES_AT_ONCE, QUERIES, DOCUMENTS = 10_000, 256, 256


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, f."""
    return docs.select(key, F.explode(tokenize(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("f"))


def bm25(docs: DataFrame, query: list[str], key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """docs with bm25: every row keeps a score, zero without a common term.

    Counts per query term are made beside each text, so nothing is exploded or joined back: one pass for the corpus
    statistics (a single aggregated row), one for the scores.
    """
    terms = list(dict.fromkeys(query))
    if not terms:
        return docs.withColumn("bm25", F.lit(0.0))
    weight = {t: query.count(t) for t in terms}
    tokens = tokenize(F.col(text))
    frequency = lambda t: F.size(F.filter(F.col("_tokens"), lambda x: x == t))
    counted = docs.withColumn("_tokens", tokens).select("*", F.size("_tokens").alias("_len"), *(frequency(t).alias(f"_f{k}") for k, t in enumerate(terms))).drop("_tokens")
    stats = counted.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *(F.count_if(F.col(f"_f{k}") > 0).alias(f"df{k}") for k in range(len(terms)))).first()
    n, average = stats["n"], max(1.0, stats["avg"] or 0.0)
    score = F.lit(0.0)
    for k, t in enumerate(terms):
        df = float(stats[f"df{k}"])
        idf = F.greatest(F.lit(0.0), F.log(F.lit(1.0 + (n - df + 0.5) / (df + 0.5))))
        f = F.col(f"_f{k}").cast("double")
        score = score + float(weight[t]) * idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_len") / average))
    return counted.withColumn("bm25", score).drop("_len", *(f"_f{k}" for k in range(len(terms))))


def bm25_many(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, digits: int | None = None, best: int | None = None) -> DataFrame:
    """query_id, key, bm25 for a table of queries (query_id, query); hits only.

    The terms that the queries ask for are numbered and broadcast, with the queries as rows of their numbers.  One pass over
    the texts counts them, their lengths and the documents of each term; a second multiplies a few hundred texts at a time
    with some queries at a time.  A text's scores are made where it lies, nothing but the counts is shuffled, and a task
    holds one such product.  digits: as many decimals are kept.  best: of each task at least the best so many of each query
    are given, ties by key, and others left out.
    """
    spark, kinds = docs.sparkSession, dict(queries.dtypes) | dict(docs.dtypes)
    asked = queries.select("query_id", tokenize(F.col("query")).alias("t")).groupBy("query_id").agg(F.flatten(F.collect_list("t")).alias("t")).filter(F.size("t") > 0)
    tokens = docs.select(F.col(key), tokenize(F.col(text)).alias("t")).filter("t is not null")
    out = spark.createDataFrame([], f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, bm25 double")
    rows: list = []
    known: dict = {}

    def scored(own: list) -> DataFrame:
        vocabulary = sorted({t for r in own for t in r["t"]})
        number = {t: k for k, t in enumerate(vocabulary)}
        terms = spark.sparkContext.broadcast((vocabulary, [[number[t] for t in r["t"]] for r in own], pa.array([r["query_id"] for r in own], to_arrow_type(queries.schema["query_id"].dataType))))

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values = pa.array(terms.value[0])
            df, n, length = np.zeros(len(values), np.int64), 0, 0
            for batch in batches:
                for t in _pieces(batch.column(0)):
                    doc, term, _, size = _frequencies(t, values)
                    df += np.bincount(term, minlength=len(values))
                    n, length = n + len(t), length + int(size.sum())
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n)), pa.array(np.append(np.zeros(len(at), np.int64), length))], names=["term", "df", "len"])

        if "n" not in known:
            known["n"] = docs.count()
        found = {r["term"]: (r["df"], r["len"]) for r in tokens.select("t").mapInArrow(counts, "term int, df bigint, len bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("len").alias("len")).collect()}
        n, (with_text, length) = known["n"], found.get(-1, (0, 0))
        average = max(1.0, length / with_text if with_text else 0.0)
        df = np.array([found.get(k, (0, 0))[0] for k in range(len(vocabulary))], np.float64)
        idf = np.maximum(0.0, np.log(1 + (n - df + 0.5) / (df + 0.5)))

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, own_terms, ids = pa.array(terms.value[0]), terms.value[1], terms.value[2]
            tiles = []
            for s in range(0, len(own_terms), QUERIES):
                query = np.repeat(np.arange(len(own_terms[s : s + QUERIES])), [len(t) for t in own_terms[s : s + QUERIES]])
                used, column = np.unique(np.concatenate(own_terms[s : s + QUERIES]).astype(np.int64), return_inverse=True)
                tiles.append((s, used, column.ravel(), query, int(query[-1]) + 1))
            for batch in batches:
                at = 0
                for t in _pieces(batch.column(1)):
                    doc, term, f, size = _frequencies(t, values)
                    part = f * (k1 + 1) / (f + k1 * (1 - b + b * size[doc] / average)) * idf[term]
                    keys = batch.column(0).slice(at, len(t))
                    at += len(t)
                    for s, used, column, query, width in tiles:
                        weight = np.zeros((len(used), width))
                        np.add.at(weight, (column, query), 1.0)
                        place = np.searchsorted(used, term)
                        there = (place < len(used)) & (used[np.minimum(place, len(used) - 1)] == term)
                        matrix = np.zeros((len(t), len(used)))
                        matrix[doc[there], place[there]] = part[there]
                        score = (matrix @ weight).T
                        q, d = np.nonzero(score > 0)  # every idf is above zero, so these are the hits
                        value = score[q, d]
                        if digits is not None:
                            value = np.floor(value * 10.0**digits + 0.5) / 10.0**digits
                        if best is not None and len(q):
                            order = np.lexsort((pa.compute.rank(keys, "ascending", tiebreaker="dense").to_numpy()[d], -value, q))
                            start = np.searchsorted(q, np.arange(width))
                            kept = order[np.arange(len(q)) - start[q[order]] < best]
                            q, d, value = q[kept], d[kept], value[kept]
                        if len(q):
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + s)), keys.take(pa.array(d)), pa.array(value)], names=["query_id", key, "bm25"])

        return tokens.mapInArrow(product, out.schema)

    for r in asked.toLocalIterator():
        rows.append(r)
        if len(rows) >= QUERIES_AT_ONCE:
            out, rows = out.unionByName(scored(rows)), []
    return out.unionByName(scored(rows)) if rows else out


def _pieces(tokens: pa.Array) -> Iterator[pa.Array]:
    for s in range(0, len(tokens), DOCUMENTS):
        yield tokens.slice(s, DOCUMENTS)


def _frequencies(tokens: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, term, f: how often each text holds each of the values, by number; and the number of tokens of each text."""
    size = pa.compute.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    found = pa.compute.fill_null(pa.compute.index_in(tokens.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)[found >= 0]
    cell, f = np.unique(doc * len(values) + found[found >= 0], return_counts=True)
    return cell // max(1, len(values)), cell % max(1, len(values)), f.astype(np.float64), size


def keyword_hits(haystack: Column, query: str) -> Column:
    """How many tokens of the query, repeats included, are substrings of the lower-case haystack."""
    low = F.lower(haystack)
    return sum((F.when(low.contains(t), 1).otherwise(0) for t in tokens_of(query)), F.lit(0))


def prefilter(docs: DataFrame, haystack: Column, query: str, pos: str, scan: int | None = 80, keep: int = 12) -> DataFrame:
    """The `keep` rows with most hits among the first `scan` (all with None), ties by position; rows without a hit too."""
    rows = docs if scan is None else docs.orderBy(pos).limit(scan)
    return rows.withColumn("hits", keyword_hits(haystack, query)).orderBy(F.desc("hits"), pos).limit(keep)
