"""Hybrid search over knowledge records: candidates, filters, scores, boosts, reranking, diversity."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.text import expanded, merged_terms, tokens_of
from quillmark.functions.vectors import Embedder, EmbeddingModel, cosine, embed
from quillmark.operators import fusion, lexical, nearest, providers, rerank
from quillmark.operators.knowledge import normalized, union_first
from quillmark.sources.shared import checkpointed

LIMIT, DATA_LIMIT, FALLBACK = 8, 12, 0.5
#: Queries of a table that are broadcast together.
QUERIES_AT_ONCE = 10_000
#: Places of records before those of the next table begin.
AFTER = 1 << 40
#: What asks for older records, anywhere in a query.
HISTORY = re.compile("(?i)originally|previously|history|before|earlier|superseded")
RESULT = ("id", "kind", "text", "score", "place")


@dataclass(frozen=True)
class Request:
    """What a search asks for.  Singular fields are folded into the plural ones; the limit follows the kinds."""

    workspace_id: str | None = None
    notebook_id: str | None = None
    cell_id: str | None = None
    scope: str = "workspace"  # or all
    kinds: tuple[str, ...] = ()
    kind: str | None = None
    dataset_ids: tuple[str, ...] = ()
    dataset_id: str | None = None
    column: str | None = None
    include_superseded: bool | None = None
    limit: int | None = None
    expand: bool = True
    hybrid: bool = True
    rerank: bool = True
    extra_terms: tuple[str, ...] = ()
    include_system: bool = True

    def normalized(self, query: str) -> Request:
        kinds = self.kinds or ((self.kind,) if self.kind else ())
        datasets = self.dataset_ids or ((self.dataset_id,) if self.dataset_id else ())
        limit = self.limit if self.limit is not None else DATA_LIMIT if "data_representative" in kinds else LIMIT
        old = self.include_superseded if self.include_superseded is not None else bool(HISTORY.search(query))
        return replace(self, kinds=kinds, kind=None, dataset_ids=datasets, dataset_id=None, limit=limit, include_superseded=old)


def of_kinds(kinds: Sequence[str]) -> Column:
    return F.col("kind").isin(*kinds)


def of_datasets(ids: Sequence[str]) -> Column:
    """Records without a dataset don't pass."""
    own = F.coalesce(F.col("provenance.dataset_ids"), F.when(F.col("dataset_id").isNotNull(), F.array("dataset_id")))
    return F.coalesce(F.arrays_overlap(own, F.array(*map(F.lit, ids))), F.lit(False))


def of_column(name: str) -> Column:
    m = F.col("metadata")
    own = F.coalesce(F.col("provenance.columns"), m["columns"], F.when(m["column"].isNotNull(), F.array(m["column"])))
    return F.coalesce(F.array_contains(own, name), F.lit(False))


def current() -> Column:
    return ~F.col("metadata.status").eqNullSafe("superseded")


def candidates(records: DataFrame, request: Request) -> DataFrame:
    """Stored records in scope, pruned by workspace: of the active cell first, then its notebook, then the workspace."""
    if request.scope == "all":
        return records
    if request.workspace_id is None and request.notebook_id is None:
        return records.limit(0)
    mine = F.lit(False)
    if request.workspace_id is not None:
        mine = mine | (F.col("workspace_id") == request.workspace_id)
    if request.notebook_id is not None:
        mine = mine | (F.col("notebook_id") == request.notebook_id)
    own = records.filter(mine)
    if request.cell_id is not None:
        return union_first(own.filter(F.col("cell_id") == request.cell_id), own)
    return own


def filtered(records: DataFrame, request: Request) -> DataFrame:
    """By kinds, datasets, column and status.  Scores come after: corpus statistics are those of what is left."""
    if request.kinds:
        records = records.filter(of_kinds(request.kinds))
    if request.dataset_ids:
        records = records.filter(of_datasets(request.dataset_ids))
    if request.column:
        records = records.filter(of_column(request.column))
    return records if request.include_superseded else records.filter(current())


def later(records: DataFrame, k: int) -> DataFrame:
    """Records that come after the stored ones, as the k-th table."""
    return normalized(records).withColumn("_pos", F.col("_pos") + F.lit(k * AFTER))


class VectorCache(Protocol):
    """What search() needs of a cache of embeddings: sources.knowledge_store.EmbeddingCache, or another."""

    def get(self, model: str, texts: DataFrame) -> DataFrame: ...

    def set(self, model: str, vectors: DataFrame) -> DataFrame: ...


def search(records: DataFrame, query: str, request: Request, embedder: Embedder | EmbeddingModel | None = None, vectors: DataFrame | None = None, extra: Sequence[DataFrame] = (), appended: Sequence[DataFrame] = (), cells: DataFrame | None = None, cache: VectorCache | None = None) -> DataFrame:
    """id, kind, text, score, place: the best records for a query.

    extra: provider records, of which stored ones with the same id win; appended: records added as they are; so are
    the fixed catalogues' rows for the query, unless the request leaves system knowledge out.
    vectors: (text, vector) known already; missing texts go through the embedder, each once.  cells: id, idx, for
    distances.  Without an embedder ranking is lexical only.  A query without text, and an embedder that fails on the
    query or on a text, give the first records, all with the same score.  Vectors of the candidates are made before they
    are ranked, so that a failure shows here; what isn't the embedder's own error is raised.  A configured model brings its
    name, under which a cache is read before the model is asked, and keeps what it made.
    """
    model = embedder if isinstance(embedder, EmbeddingModel) else None
    embedder = model.embedder() if model else embedder
    request = request.normalized(query)
    found = candidates(normalized(records), request)
    if request.scope != "all" and request.workspace_id is None and request.notebook_id is None:
        return first_ones(found, 0)
    if extra:
        found = union_first(found, *(later(e, k) for k, e in enumerate(extra, 1)))
    system = [make(query)(records.sparkSession, request.workspace_id or "") for make in (providers.dictionary_provider, providers.functionality_provider)] if request.include_system else []
    for k, more in enumerate((*appended, *system), len(extra) + 1):
        found = found.unionByName(later(more, k))
    found = filtered(found, request)
    if not query.strip():
        return first_ones(found, request.limit)
    tokens = tokens_of(query)
    terms = merged_terms(tokens, expanded(tokens) if request.expand else [], [t for e in request.extra_terms for t in tokens_of(e)])
    scored = lexical.bm25(found, terms, key="id")
    vector = None
    if embedder is not None:
        try:
            vector = [float(x) for x in embedder([query])[0]]
        except Exception:  # any failing model
            return first_ones(found, request.limit)
        texts = scored.select("text")
        if cache is not None and model is not None:
            cached = checkpointed(cache.get(model.name, texts).select("text", "vector"))
            vectors = cached if vectors is None else vectors.select("text", "vector").unionByName(cached.join(vectors.select("text"), "text", "left_anti"))
        missing = texts if vectors is None else texts.join(vectors, "text", "left_anti")
        try:
            made = checkpointed(embed(missing, "text", embedder).select("text", "vector"))
        except PythonException:  # of the model, in a task
            return first_ones(found, request.limit)
        if cache is not None and model is not None and not made.isEmpty():
            cache.set(model.name, made)
        known = made if vectors is None else vectors.select("text", "vector").unionByName(made)
    if vector is not None:
        scored = scored.join(known.select("text", "vector"), "text", "left")
        scored = scored.withColumn("dense", F.coalesce(cosine(F.col("vector"), F.array(*map(F.lit, vector))), F.lit(0.0)))
    else:
        scored = scored.withColumn("vector", F.lit(None).cast("array<float>")).withColumn("dense", F.lit(0.0))
    scored = scored.withColumn("_order", F.concat(F.lpad(F.col("_pos").cast("string"), 20, "0"), F.col("id")))
    ranked = fusion.fused(scored, ["dense", "bm25"] if vector is not None else ["bm25"], "_order") if request.hybrid else scored.withColumn("rrf", F.col("dense"))
    p, m = F.col("provenance"), F.col("metadata")
    distances: dict[str, Column] = {}
    if cells is not None and request.cell_id is not None:
        at = cells.filter(F.col("id") == request.cell_id).select("idx").first()
        if at is not None:
            places = F.broadcast(cells.select("id", "idx")) if cells.count() <= 100_000 else cells.select("id", "idx")
            ranked = ranked.join(places.toDF("cell_id", "_cell_idx"), "cell_id", "left").join(places.toDF("_source", "_source_idx"), p["cell_id"] == F.col("_source"), "left")
            distances = {"distance": F.col("_cell_idx") - at[0], "source_distance": F.col("_source_idx") - at[0]}
    raised = fusion.boost(
        m["status"],
        in_dataset=of_datasets(request.dataset_ids) if request.dataset_ids else None,
        own_cell=F.col("cell_id") == request.cell_id if request.cell_id else None,
        source_cell=p["cell_id"] == request.cell_id if request.cell_id else None,
        in_column=F.array_contains(F.coalesce(p["columns"], m["columns"]), request.column) if request.column else None,
        **distances,
    )
    ranked = ranked.withColumn("score", F.col("rrf") + raised)
    if not request.rerank:
        return placed(ranked.orderBy(F.desc("score"), "_order").limit(request.limit), F.desc("score"), F.col("_order"))
    pool = ranked.orderBy(F.desc("score"), "_order").limit(max(request.limit, rerank.POOL))
    again = rerank.rerank(pool, query)
    picked = rerank.mmr(again, request.limit, "id", pos="_order", rank="rank" if "rank" in again.columns else None)
    return again.select("id", "kind", "text").join(picked, "id").select(*RESULT)


def placed(top: DataFrame, *order: Column) -> DataFrame:
    """The result's columns of a bounded number of rows."""
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).select(*RESULT)


def first_ones(found: DataFrame, limit: int) -> DataFrame:
    return placed(found.orderBy("_pos", "id").limit(limit).withColumn("score", F.lit(FALLBACK)), F.col("_pos"), F.col("id"))


def vector_search(vectors: DataFrame, query: Sequence[float], k: int = 5, condition: Column | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k rows nearest to the query by cosine, ties by key: a bounded top-k on every partition, then one merge."""
    rows = vectors if condition is None else vectors.filter(condition)
    score = cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return rows.withColumn("score", score).orderBy(F.col("score").desc_nulls_last(), key).limit(k)


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id", at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """query_id, key, score, place: the k rows nearest to each query (query_id, query) by cosine, ties by key.

    At most `at_once` queries go out in one chunk, each chunk scans the vectors once; rows meet queries of their own
    length only.  Tasks keep k rows for each query before anything is shuffled.
    """
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), key)
    kinds = dict(queries.dtypes) | dict(vectors.dtypes)
    out = vectors.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, `{key}` {kinds[key]}, score double, place int")
    for k_chunk, chunk in enumerate(nearest.chunks(queries, at_once)):
        asked = vectors.sparkSession.sparkContext.broadcast(chunk)
        top = checkpointed(nearest.nearest(vectors, asked, k, vector, key).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k))
        asked.destroy()
        out = top if not k_chunk else out.unionByName(top)
    return out


def recall_at(golden: DataFrame, ranked: DataFrame, k: int = 3) -> DataFrame:
    """recall: the share of golden (query_id, id) that are among the first k places of ranked (query_id, id, place)."""
    top = ranked.filter(F.col("place") <= k).select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return golden.join(top, ["query_id", "id"], "left").agg(F.count("*").alias("queries"), F.count("hit").alias("hits"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
