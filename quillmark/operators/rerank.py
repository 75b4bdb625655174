"""Reranking: lexical features, a seam for other rerankers, and maximal marginal relevance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillmark.functions.text import tokenize, tokens_of

POOL, LAMBDA = 24, 0.7
COVERAGE, PHRASE, PROXIMITY, SPAN = 2.0, 1.5, 0.5, 10
Reranker = Callable[[DataFrame, str], DataFrame]


def feature_score(text: Column, query: str) -> Column:
    """Share of query tokens, repeats included, that occur; the query as a phrase; all tokens close together at their first places.

    Zero for a query or a text without tokens.
    """
    tokens = tokens_of(query)
    if not tokens:
        return F.lit(0.0)
    phrase = query.strip().lower()
    words = tokenize(text)
    by_phrase = F.when(F.lower(text).contains(phrase), PHRASE).otherwise(0.0) if len(phrase) > 3 else F.lit(0.0)
    places = F.array(*(F.array_position(words, t) for t in tokens))
    covered = F.size(F.filter(places, lambda p: p > 0)) / float(len(tokens))
    near = F.when((covered == 1) & (F.array_max(places) - F.array_min(places) <= SPAN), PROXIMITY).otherwise(0.0) if len(tokens) > 1 else F.lit(0.0)
    return F.when(F.size(words) > 0, COVERAGE * covered + by_phrase + near).otherwise(0.0)


def by_features(pool: DataFrame, query: str, text: str = "text", score: str = "score", order: str | None = None) -> DataFrame:
    """Adds features, prior (the score before) and rank, and raises the score by the features.

    rank orders by features, then the score before, then `order`.  The pool is bounded, so one task ranks it.
    """
    featured = pool.withColumn("features", feature_score(F.col(text), query)).withColumn("prior", F.col(score))
    ties = [order] if order else [c for c in ("_order", "_pos") if c in pool.columns]
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("features"), F.desc_nulls_last("prior"), *ties)
    return featured.withColumn("rank", F.row_number().over(best)).withColumn(score, F.col(score) + F.col("features"))


_reranker: list[Reranker] = [by_features]


def set_reranker(reranker: Reranker | None) -> None:
    """Replaces the default of rerank(); None restores it."""
    _reranker[0] = reranker or by_features


def rerank(pool: DataFrame, query: str) -> DataFrame:
    return _reranker[0](pool, query)


def mmr(pool: DataFrame, top: int | str, key: str, score: str = "score", vector: str = "vector", pos: str = "_pos", query: str | None = None, weight: float = LAMBDA, rank: str | None = None) -> DataFrame:
    """The pool's `top` rows, or as many as a column of that name says, by greedy maximal marginal relevance, with their place.

    The pool's order is that of `rank`, as a reranker gives it, or else by score.  A pool that isn't larger keeps it.  Pools are bounded by the rank filter before (24 rows by default), so a
    group is one small Arrow batch.  Rows without a vector are similar to nothing; ties go to the row that came first.
    """
    group = [query] if query else []
    schema = T.StructType([*(pool.schema[c] for c in [*group, key, score]), T.StructField("place", T.IntegerType())])

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = (rows.sort_values(rank, kind="stable") if rank else rows.sort_values([score, pos], ascending=[False, True], kind="stable")).reset_index(drop=True)
        order = list(range(len(rows)))
        most = top if isinstance(top, int) else int(rows[top].iloc[0])
        if len(rows) > most:
            unit = [None if v is None or not np.linalg.norm(v) else np.asarray(v, float) / np.linalg.norm(v) for v in rows[vector]]
            scores, order = rows[score].to_numpy(float), []
            while len(order) < most:
                best, best_at = -np.inf, -1
                for k in range(len(rows)):
                    if k in order:
                        continue
                    like = max((float(unit[k] @ unit[j]) for j in order if unit[k] is not None and unit[j] is not None and len(unit[k]) == len(unit[j])), default=0.0)
                    value = weight * scores[k] - (1 - weight) * max(0.0, like)
                    if value > best:
                        best, best_at = value, k
                order.append(best_at)
        out = rows.iloc[order][[*group, key, score]].copy()
        out["place"] = range(1, len(order) + 1)
        return out

    keyed = pool.select(*dict.fromkeys([*group, key, score, vector, pos, *([rank] if rank else []), *([] if isinstance(top, int) else [top])]))
    return keyed.groupBy(*group).applyInPandas(pick, schema)
