"""Retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions import vectors as V
from quillmark.operators import batch, fusion, lexical, rerank, search, vector_index
from quillmark.plans.common import QUERY, rounded, rounded_sql, table, tokens_sql
from quillmark.sources.shared import checkpointed, temporary_store

TERMS = T.tokens_of(QUERY)
#: Tokens by which a document that may hold a passage is found.
SHINGLE = 8
_LIST = ", ".join(f"('{t}', {TERMS.count(t)})" for t in dict.fromkeys(TERMS))

BM25_CTE = f"""toks AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents), lens AS (SELECT doc_id, len(t) AS l FROM toks),
 stats AS (SELECT count(*) AS n, greatest(1.0, avg(l)) AS a FROM lens), q(term, qtf) AS (VALUES {_LIST}),
 tf AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
 bm AS (SELECT doc_id, sum(qtf * greatest(0.0, ln(1 + (n - d + 0.5) / (d + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))) AS s FROM tf JOIN q USING (term) JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY doc_id),
 scored AS (SELECT doc_id, coalesce(s, 0.0) AS bm25 FROM lens LEFT JOIN bm USING (doc_id))"""


def tokenize_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = lexical.term_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text")
    return tf.groupBy("term").agg(F.sum("f").alias("tf"), F.count("*").alias("df"))


TOKENIZE_TF = f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term"


def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25(table(spark, sf_dir, "documents"), TERMS).select("doc_id", rounded("bm25"))


BM25_ALL = f"WITH {BM25_CTE} SELECT doc_id, {rounded_sql('bm25', 6)} AS bm25 FROM scored"


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_all(spark, sf_dir).orderBy(F.desc("bm25"), "doc_id").limit(10)


BM25_TOPK = BM25_ALL + " ORDER BY 2 DESC, 1 LIMIT 10"


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.bm25_many(table(spark, sf_dir, "documents"), queries).select("query_id", "doc_id", rounded("bm25"))


BM25_BATCH = f"""WITH toks AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents), lens AS (SELECT doc_id, len(t) AS l FROM toks), stats AS (SELECT count(*) AS n, greatest(1.0, avg(l)) AS a FROM lens),
 q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tokens_sql("text")}) AS term FROM benchmark) GROUP BY ALL),
 tf AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term)
 SELECT query_id, doc_id, {rounded_sql("sum(qtf * greatest(0.0, ln(1 + (n - d + 0.5) / (d + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a)))", 6)} AS bm25 FROM q JOIN df USING (term) JOIN tf USING (term) JOIN lens USING (doc_id), stats GROUP BY query_id, doc_id"""


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[]))"


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 5).select("vec_id", rounded("score"))


COSINE_TOPK = f"SELECT e.vec_id, {rounded_sql(COSINE, 6)} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z ORDER BY {COSINE} DESC, e.vec_id LIMIT 5"


def cosine_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set is every vector whose number is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.vector_search_many(vectors, queries, 5).select("query_id", "vec_id", "place", rounded("score"))


COSINE_TOPK_MANY = f"SELECT query_id, vec_id, CAST(place AS INTEGER) AS place, {rounded_sql('s', 6)} AS score FROM (SELECT z.vec_id AS query_id, e.vec_id, {COSINE} AS s, row_number() OVER (PARTITION BY z.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS place FROM embeddings e JOIN embeddings z ON z.vec_id % 50 = 0) WHERE place <= 5"


def cosine_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same searches over vectors laid out by pivots, without reading those that can't be near."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    width = vectors.select(F.max(F.size("embedding"))).first()[0] or 1
    found, _ = vector_index.VectorIndex.build(vectors, temporary_store(spark, "pivots") + "/rows", width).search(queries, 5)
    return found.select("query_id", "vec_id", "place", rounded("score"))


def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 8, F.col("label").isin(1, 2, 3)).select("vec_id", "label", rounded("score"))


VECTOR_FILTERED = f"SELECT e.vec_id, e.label, {rounded_sql(COSINE, 6)} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z WHERE e.label IN (1, 2, 3) ORDER BY {COSINE} DESC, e.vec_id LIMIT 8"


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with both scores; the vector is that of the same number, and without one dense is zero."""
    docs = lexical.bm25(table(spark, sf_dir, "documents"), TERMS)
    vector = F.array(*map(F.lit, _query_vector(spark, sf_dir)))
    both = docs.join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return both.withColumn("dense", F.coalesce(V.cosine(F.col("embedding"), vector), F.lit(0.0))).withColumn("bm25", rounded("bm25")).withColumn("dense", rounded("dense"))


RRF_CTE = BM25_CTE + f""", pairs AS (SELECT s.doc_id, {rounded_sql("s.bm25", 6)} AS bm25, {rounded_sql(f"coalesce({COSINE}, 0.0)", 6)} AS dense, e.label FROM scored s LEFT JOIN embeddings e ON s.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) z),
 fused AS (SELECT *, 1.0 / (60 + row_number() OVER (ORDER BY dense DESC, doc_id)) + 1.0 / (60 + row_number() OVER (ORDER BY bm25 DESC, doc_id)) AS rrf FROM pairs)"""


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused(_both(spark, sf_dir).select("doc_id", "dense", "bm25"), ["dense", "bm25"], "doc_id").select("doc_id", F.round("rrf", 9).alias("rrf"))


HYBRID_RRF = f"WITH {RRF_CTE} SELECT doc_id, round(rrf, 9) AS rrf FROM fused"


def hybrid_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool that goes on to reranking: the best by fused score, without a rank for every document."""
    both = checkpointed(_both(spark, sf_dir).select("doc_id", "dense", "bm25"))
    return fusion.pool(both, ["dense", "bm25"], "doc_id", rerank.POOL).select("doc_id", F.round("rrf", 9).alias("rrf"))


HYBRID_POOL = f"WITH {RRF_CTE} SELECT doc_id, round(rrf, 9) AS rrf FROM fused ORDER BY fused.rrf DESC, doc_id LIMIT {rerank.POOL}"


def boosted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "superseded").otherwise("stale")
    ranked = fusion.fused(_both(spark, sf_dir).select("doc_id", "dense", "bm25", "source", "lang", "label"), ["dense", "bm25"], "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    raised = fusion.boost(status, in_dataset=F.col("source") == "src1", own_cell=F.col("label") == 1, source_cell=F.col("label") == 1, in_column=F.col("lang") == "de", distance=F.col("label") - 3, source_distance=F.col("label") - 5)
    return ranked.select("doc_id", F.round(F.col("rrf") + raised, 9).alias("score"))


BOOSTED_SEARCH = f"""WITH {RRF_CTE} SELECT f.doc_id, round(rrf + CASE WHEN quality = 1 THEN 0.15 WHEN quality = 0 THEN -0.1 ELSE 0.05 END + CASE WHEN source = 'src1' THEN 0.2 ELSE 0.0 END + CASE WHEN label = 1 THEN 0.3 + 0.3 ELSE 0.0 END
 + CASE WHEN lang = 'de' THEN 0.2 ELSE 0.0 END + coalesce(0.15 / (1 + abs(label - 3)), 0.0) + coalesce(0.1 / (1 + abs(label - 5)), 0.0), 9) AS score FROM fused f JOIN documents d ON f.doc_id = d.doc_id LEFT JOIN labels l ON f.doc_id = l.doc_id"""

FEATURE_QUERY = "the and the"


def feature_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = bm25_all(spark, sf_dir).orderBy(F.desc("bm25"), "doc_id").limit(rerank.POOL).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumnRenamed("bm25", "score")
    return rerank.by_features(pool, FEATURE_QUERY, order="doc_id").select("doc_id", "features", "rank", rounded("score"))


FEATURE_RERANK = f"""WITH {BM25_CTE}, pool AS (SELECT doc_id, {rounded_sql("bm25", 6)} AS score FROM scored ORDER BY 2 DESC, 1 LIMIT 24),
 x AS (SELECT p.doc_id, score, lower(text) AS low, coalesce(list_position(t, 'the'), 0) AS a, coalesce(list_position(t, 'and'), 0) AS b FROM pool p JOIN documents USING (doc_id) JOIN toks USING (doc_id)),
 y AS (SELECT doc_id, score, 2.0 * (2 * CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER)) / 3.0 + CASE WHEN contains(low, '{FEATURE_QUERY}') THEN 1.5 ELSE 0.0 END + CASE WHEN a > 0 AND b > 0 AND abs(a - b) <= 10 THEN 0.5 ELSE 0.0 END AS features FROM x)
 SELECT doc_id, features, CAST(row_number() OVER (ORDER BY features DESC, score DESC, doc_id) AS INTEGER) AS rank, {rounded_sql("score + features", 6)} AS score FROM y"""


def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = search.vector_search(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), rerank.POOL)
    return rerank.mmr(pool, 8, "vec_id", vector="embedding", pos="vec_id").select("place", "vec_id", rounded("score"))


def keyword_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.prefilter(table(spark, sf_dir, "benchmark"), F.col("text"), "the and the thing", "item_id").select("item_id", "hits")


KEYWORD_PREFILTER = """SELECT item_id, hits FROM (SELECT item_id, CAST(2 * CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'and') AS INTEGER) + CAST(contains(lower(text), 'thing') AS INTEGER) AS INTEGER) AS hits FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 80)) ORDER BY hits DESC, item_id LIMIT 12"""


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "benchmark").select(F.explode(T.tokenize(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", T.singular(F.col("token")).alias("singular"), T.plural(F.col("token")).alias("plural"))


QUERY_EXPANSION = f"""WITH t AS (SELECT DISTINCT unnest({tokens_sql("text")}) AS token FROM benchmark)
 SELECT token, CASE WHEN length(token) <= 3 THEN NULL WHEN token LIKE '%ies' AND length(token) > 4 THEN substr(token, 1, length(token) - 3) || 'y' WHEN regexp_matches(token, '(s|x|z|ch|sh)es$') THEN substr(token, 1, length(token) - 2)
  WHEN token LIKE '%s' AND token NOT LIKE '%ss' THEN substr(token, 1, length(token) - 1) END AS singular,
  CASE WHEN length(token) <= 3 OR token LIKE '%s' THEN NULL WHEN token LIKE '%y' THEN substr(token, 1, length(token) - 1) || 'ies' ELSE token || 's' END AS plural FROM t"""


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "piece"))
    return docs.select("doc_id", "chunk", F.length("piece").alias("n_chars"), F.substring(F.sha2("piece", 256), 1, 12).alias("hash"))


CHUNK_DOCUMENTS = """SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(length(substr(text, i * 1848 + 1, 2048)) AS INTEGER) AS n_chars, substr(sha256(substr(text, i * 1848 + 1, 2048)), 1, 12) AS hash
 FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 2048 THEN 1 ELSE CAST(1 + ceil((length(text) - 2048) / 1848.0) AS BIGINT) END)) AS i FROM documents)"""


def mean_pool_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = V.mean_pooled(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "x")).select("label", "dim", rounded("x"))


MEAN_POOL = f"""WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), m AS (SELECT label, dim, avg(v) AS a FROM x GROUP BY ALL)
 SELECT label, CAST(dim AS INTEGER) AS dim, {rounded_sql("a / sqrt(sum(a * a) OVER (PARTITION BY label))", 6)} AS x FROM m"""


def holders(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """query_id, id: documents that hold the tokens of a passage in a row, found by the passage's first shingle."""
    spaced = lambda tokens: F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    asked = bench.select("query_id", T.tokenize(F.col("query")).alias("_q")).filter(F.size("_q") > 0).withColumn("_n", F.least(F.size("_q"), F.lit(SHINGLE)))
    asked = asked.select("query_id", spaced(F.col("_q")).alias("passage"), F.xxhash64(F.slice("_q", 1, F.col("_n"))).alias("shingle"))
    own = docs.select(F.col("doc_id").alias("id"), T.tokenize(F.col("text")).alias("_t"))
    out = None
    # A passage shorter than a shingle is looked up by all its tokens, so each length from 1 on has a pass over the windows.
    windows = lambda n: F.transform(F.sequence(F.lit(1), F.size("_t") - n + 1), lambda k: F.xxhash64(F.slice("_t", k, n)))
    lengths = [r[0] for r in bench.select(F.least(F.size(T.tokenize(F.col("query"))), F.lit(SHINGLE))).distinct().collect() if r[0] and r[0] > 0]
    for n in sorted(lengths):
        found = own.filter(F.size("_t") >= n).select("id", F.explode(F.array_distinct(windows(n))).alias("shingle"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.select(F.lit(None).cast("long").alias("query_id"), F.col("doc_id").alias("id")).limit(0)
    near = out.join(asked, "shingle").select("query_id", "id", "passage").distinct()
    return near.join(own, "id").filter(F.contains(spaced(F.col("_t")), F.col("passage"))).select("query_id", "id").distinct()


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, against the three best by BM25 for it."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents")
    ranked = lexical.bm25_many(docs, bench, digits=6, best=3).withColumn("place", fusion.rank_by("bm25", "doc_id", "query_id")).withColumnRenamed("doc_id", "id")
    golden = holders(docs, bench)
    return search.recall_at(golden, ranked, 3).join(bench.agg(F.count("*").alias("asked")), F.lit(True))


RECALL = f"""WITH b AS ({BM25_BATCH}), r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS place FROM b),
 own AS (SELECT doc_id, ' ' || array_to_string({tokens_sql("text")}, ' ') || ' ' AS t FROM documents), asked AS (SELECT item_id AS query_id, array_to_string({tokens_sql("text")}, ' ') AS p FROM benchmark),
 g AS (SELECT query_id, doc_id FROM asked JOIN own ON p <> '' AND contains(t, ' ' || p || ' '))
 SELECT count(*) AS queries, count(*) FILTER (WHERE place <= 3) AS hits, count(*) FILTER (WHERE place <= 3) / CAST(count(*) AS DOUBLE) AS recall, (SELECT count(*) FROM benchmark) AS asked FROM g LEFT JOIN r USING (query_id, doc_id)"""


def full_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search over documents as records, with the hashing embedder."""
    from quillmark.operators.knowledge import records

    docs = table(spark, sf_dir, "documents")
    own = records(docs, id=F.col("doc_id"), kind="note", text=F.col("text"), workspace=F.lit("w"), dataset=F.col("source"), metadata={"status": F.when(F.col("doc_id") % 5 == 0, "superseded").otherwise("active"), "source": F.lit("document")}, provenance={"dataset_ids": F.array("source"), "columns": F.array("lang")}, pos=F.col("doc_id"))
    request = search.Request(workspace_id="w", dataset_ids=("src1", "src2"), column="en")
    return search.search(own, QUERY, request, V.hashed_words(64))


def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of the benchmark as searches at once, with filters of their own; the records that go on to reranking."""
    from quillmark.operators.knowledge import records

    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    status = F.when(F.col("doc_id") % 5 == 0, "superseded").when(F.col("doc_id") % 5 > 1, "active")
    own = records(docs, id=F.col("doc_id"), kind="note", text=F.col("text"), workspace=F.lit("w"), dataset=F.col("source"), metadata={"status": status}, provenance={"dataset_ids": F.array("source"), "columns": F.array("lang")}, pos=F.col("doc_id"))
    n = F.col("item_id")
    datasets = F.when(n % 4 == 0, F.array(*(F.lit(f"src{k}") for k in range(8))))
    requests = asked.select(n.alias("request_id"), F.col("text").alias("query"), F.lit("w").alias("workspace_id"), F.when(n % 3 == 0, "en").alias("column"), datasets.alias("dataset_ids"), (n % 2 == 0).alias("include_superseded"), F.lit(False).alias("expand"))
    return batch.pools(own, checkpointed(batch.prepared(requests))).select("request_id", "id", F.round("score", 9).alias("score"))


SEARCH_BATCH = f"""WITH q AS (SELECT item_id, {tokens_sql("text")} AS t FROM benchmark WHERE trim(text) <> ''), asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(t) AS term FROM q) GROUP BY ALL),
 d AS (SELECT doc_id, source, lang, {tokens_sql("text")} AS t FROM documents), own AS (SELECT item_id, doc_id, len(t) AS l FROM (SELECT item_id FROM q), d WHERE (item_id % 3 <> 0 OR lang = 'en') AND (item_id % 4 <> 0 OR source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7')) AND (item_id % 2 = 0 OR doc_id % 5 <> 0)),
 stats AS (SELECT item_id, count(*) AS n, greatest(1.0, avg(l)) AS a FROM own GROUP BY item_id), tf AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
 held AS (SELECT item_id, doc_id, l, term, qtf, f FROM own JOIN tf USING (doc_id) JOIN asked USING (item_id, term)), df AS (SELECT item_id, term, count(*) AS d FROM held GROUP BY ALL),
 bm AS (SELECT item_id, doc_id, sum(qtf * greatest(0.0, ln(1 + (n - d + 0.5) / (d + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a)) ORDER BY term) AS s FROM held JOIN df USING (item_id, term) JOIN stats USING (item_id) GROUP BY ALL),
 ranked AS (SELECT item_id, doc_id, 1.0 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(s, 0.0), 9) DESC, doc_id)) + CASE WHEN doc_id % 5 > 1 THEN 0.15 WHEN doc_id % 5 = 0 THEN -0.1 ELSE 0.0 END + CASE WHEN item_id % 4 = 0 THEN 0.2 ELSE 0.0 END + CASE WHEN item_id % 3 = 0 THEN 0.2 ELSE 0.0 END AS score FROM own LEFT JOIN bm USING (item_id, doc_id))
 SELECT item_id AS request_id, CAST(doc_id AS VARCHAR) AS id, round(score, 9) AS score FROM ranked QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {rerank.POOL}"""

CELL = 7


def search_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexical search from an active cell, to whose place in the notebook the records' cells are near or far."""
    from quillmark.operators.knowledge import records

    docs = table(spark, sf_dir, "documents")
    place = F.col("doc_id") % 50
    status = F.when(F.col("doc_id") % 5 == 0, "superseded").when(F.col("doc_id") % 5 > 1, "active")
    own = records(docs, id=F.col("doc_id"), kind="note", text=F.col("text"), workspace=F.lit("w"), cell=F.concat(F.lit("c"), place.cast("string")), metadata={"status": status}, provenance={}, pos=F.col("doc_id"))
    cells = docs.select(F.concat(F.lit("c"), place.cast("string")).alias("id"), place.alias("idx")).filter("idx < 40").distinct()
    request = search.Request(workspace_id="w", cell_id=f"c{CELL}", include_superseded=True, limit=60, expand=False, rerank=False, include_system=False)
    return search.search(own, QUERY, request, cells=cells).select("id", "place", F.round("score", 9).alias("score"))


SEARCH_CELLS = f"""WITH {BM25_CTE}, r AS (SELECT doc_id, doc_id % 50 AS cell, 1.0 / (60 + row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id)) AS rrf FROM scored),
 s AS (SELECT doc_id, rrf + CASE WHEN doc_id % 5 > 1 THEN 0.15 WHEN doc_id % 5 = 0 THEN -0.1 ELSE 0.0 END + CASE WHEN cell = {CELL} THEN 0.3 + 0.3 ELSE 0.0 END + CASE WHEN cell < 40 THEN 0.15 / (1 + abs(cell - {CELL})) + 0.1 / (1 + abs(cell - {CELL})) ELSE 0.0 END AS score FROM r)
 SELECT CAST(doc_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS place, round(score, 9) AS score FROM s ORDER BY score DESC, doc_id LIMIT 60"""


def search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search whose pool another reranker orders: by the length of texts."""
    from quillmark.operators.knowledge import records

    docs = table(spark, sf_dir, "documents")
    own = records(docs, id=F.col("doc_id"), kind="note", text=F.col("text"), workspace=F.lit("w"), metadata={}, provenance={}, pos=F.col("doc_id"))
    rerank.set_reranker(lambda pool, query: pool.withColumn("score", F.length("text").cast("double")))
    try:
        return search.search(own, QUERY, search.Request(workspace_id="w", limit=9, expand=False, include_system=False)).select("id", "place", "score")
    finally:
        rerank.set_reranker(None)


SEARCH_RERANKED = f"""WITH {BM25_CTE}, pool AS (SELECT doc_id FROM scored ORDER BY round(bm25, 9) DESC, doc_id LIMIT {rerank.POOL})
 SELECT CAST(doc_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY length(text) DESC, doc_id) AS INTEGER) AS place, CAST(length(text) AS DOUBLE) AS score FROM pool JOIN documents USING (doc_id) ORDER BY length(text) DESC, doc_id LIMIT 9"""


def prepared_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as requests: their limits, whether they ask for older records, and their terms."""
    said = table(spark, sf_dir, "conversations").filter("text is not null")
    kinds = F.when(F.col("turn") % 3 == 0, F.array(F.lit("data_representative"), F.lit("note")))
    asked = said.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), F.when(F.col("conv_id") % 4 == 0, F.concat("text", F.lit(" as Originally planned"))).otherwise(F.col("text")).alias("query"), kinds.alias("kinds"), F.when(F.col("turn") % 5 == 0, 3).alias("limit"), F.lit(False).alias("expand"))
    done = batch.prepared(asked)
    return done.select("request_id", "limit", "include_superseded", F.array_join("terms", " ").alias("terms"))


PREPARED_REQUESTS = f"""WITH q AS (SELECT conv_id || ':' || turn AS request_id, turn, CASE WHEN conv_id % 4 = 0 THEN text || ' as Originally planned' ELSE text END AS query FROM conversations WHERE text IS NOT NULL)
 SELECT request_id, CAST(CASE WHEN turn % 5 = 0 THEN 3 WHEN turn % 3 = 0 THEN 12 ELSE 8 END AS INTEGER) AS "limit", regexp_matches(query, '(?i)originally|previously|history|before|earlier|superseded') AS include_superseded, array_to_string({tokens_sql("query")}, ' ') AS terms FROM q"""


def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and turns that repeat, embedded through a cache that has every second passage: each text once, hits from the cache."""
    import numpy as np

    from quillmark.sources import stores

    passages, said = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(F.lit(1))
    held = passages.filter("item_id % 2 = 0").groupBy("text").agg(F.min("item_id").alias("item_id"))
    cache = held.select(T.embedding_key(F.lit("m"), F.col("text")).alias("key"), F.lit("m").alias("model"), F.array(F.lit(-1.0), F.col("item_id").cast("double")).cast("array<float>").alias("vector"), at.alias("created_at"), at.alias("used_at"))
    lengths = lambda texts: np.array([[len(t), t.count("e")] for t in texts], np.float32).reshape(-1, 2)
    texts = passages.select("text").unionByName(passages.select("text")).unionByName(said.select("text"))
    known, after = stores.through_cache(cache, texts, "m", lengths, F.timestamp_seconds(F.lit(9)))
    used = after.select("key", F.unix_timestamp("used_at").alias("used"), F.unix_timestamp("created_at").alias("made"))
    return known.withColumn("key", T.embedding_key(F.lit("m"), F.col("text"))).join(used, "key").select("key", F.get("vector", F.lit(0)).alias("first"), F.get("vector", F.lit(1)).alias("second"), "used", "made")


CACHE_SPLIT = """WITH held AS (SELECT text, min(item_id) AS i FROM benchmark WHERE item_id % 2 = 0 AND text IS NOT NULL GROUP BY text), t AS (SELECT DISTINCT text FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations) WHERE text IS NOT NULL)
 SELECT 'm:v1:' || substr(sha256(t.text), 1, 16) AS key, CAST(CASE WHEN i IS NULL THEN length(t.text) ELSE -1 END AS FLOAT) AS first, CAST(coalesce(i, length(t.text) - length(replace(t.text, 'e', ''))) AS FLOAT) AS second, CAST(9 AS BIGINT) AS used, CAST(CASE WHEN i IS NULL THEN 9 ELSE 1 END AS BIGINT) AS made FROM t LEFT JOIN held USING (text)"""

QUERIES = {
    "search_reranked": (search_reranked, SEARCH_RERANKED),
    "search_cells": (search_cells, SEARCH_CELLS),
    "prepared_requests": (prepared_requests, PREPARED_REQUESTS),
    "cache_split": (cache_split, CACHE_SPLIT),
    "search_batch": (search_batch, SEARCH_BATCH),
    "tokenize_tf": (tokenize_tf, TOKENIZE_TF),
    "bm25_all": (bm25_all, BM25_ALL),
    "bm25_topk": (bm25_topk, BM25_TOPK),
    "bm25_batch": (bm25_batch, BM25_BATCH),
    "cosine_topk": (cosine_topk, COSINE_TOPK),
    "cosine_topk_many": (cosine_topk_many, COSINE_TOPK_MANY),
    "cosine_pruned": (cosine_pruned, COSINE_TOPK_MANY),
    "vector_filtered": (vector_filtered, VECTOR_FILTERED),
    "hybrid_rrf": (hybrid_rrf, HYBRID_RRF),
    "hybrid_pool": (hybrid_pool, HYBRID_POOL),
    "boosted_search": (boosted_search, BOOSTED_SEARCH),
    "feature_rerank": (feature_rerank, FEATURE_RERANK),
    "mmr_select": (mmr_select, None),
    "keyword_prefilter": (keyword_prefilter, KEYWORD_PREFILTER),
    "query_expansion": (query_expansion, QUERY_EXPANSION),
    "chunk_documents": (chunk_documents, CHUNK_DOCUMENTS),
    "mean_pool_renorm": (mean_pool_renorm, MEAN_POOL),
    "recall_at_k": (recall_at_k, RECALL),
    "full_search": (full_search, None),
}
