"""Queries on notebooks, stores, filters and prompts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import tokens_of
from quillmark.operators import knowledge, notebook, prompt, providers, sampling, search
from quillmark.plans.common import table
from quillmark.plans.records import CELLS, _cells
from quillmark.sources import ipynb, knowledge_store, stores
from quillmark.sources.shared import temporary_store

TYPES = ("upload", "clean", "analysis", "export", "markdown")


def _full_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cells with all that a context shows."""
    what = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"))
    cells = _cells(spark, sf_dir).join(what, "id")
    output = F.array(F.struct(F.lit("table").alias("type"), F.col("title"), F.repeat("id", 100).alias("data")))
    return cells.select(
        "notebook_id", "id", "idx", F.get(F.array(*map(F.lit, TYPES)), F.col("idx") % 5).alias("type"), "status", "title", F.col("title").alias("operation"), F.array(F.lit("a"), F.lit("b")).alias("columns"), F.array(F.lit("d1")).alias("dataset_ids"),
        F.sha2("id", 256).alias("input_hash"), F.when(F.col("idx") % 2 == 1, F.sha2("id", 256)).alias("output_hash"), output.alias("outputs"), F.array().cast("array<string>").alias("source_cell_ids"), "depends_on",
    )


_KINDS = "CASE idx % 5 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TYPES)) + " END"
FULL_CELLS = f"{CELLS}, c AS (SELECT cells.*, event_type AS title, {_KINDS} AS type FROM cells JOIN events e ON cells.id = CAST(e.event_id AS VARCHAR))"


def _last_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("notebook_id").agg(F.max_by("id", "idx").alias("cell_id")).select(F.substring("notebook_id", 4, 20).alias("query_id"), "notebook_id", "cell_id")


def notebook_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of every notebook's last cell."""
    cells = _full_cells(spark, sf_dir)
    return notebook.contexts(cells, _last_cells(cells))


_LINE = "chr(10)"
CONTEXT = f"""{FULL_CELLS}, own AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY notebook_id ORDER BY idx DESC) = 1),
 prec AS (SELECT notebook_id, string_agg(line, ' | ' ORDER BY idx) AS p FROM (SELECT c.notebook_id, c.idx, 'Cell ' || c.idx || ' ' || c.type || ' ' || c.title AS line, row_number() OVER (PARTITION BY c.notebook_id ORDER BY c.idx DESC) AS rn FROM c JOIN own o ON c.notebook_id = o.notebook_id WHERE c.idx < o.idx AND c.status <> 'superseded') WHERE rn <= 5 GROUP BY notebook_id),
 ctx AS (SELECT substr(notebook_id, 4) AS query_id, concat_ws({_LINE}, 'Active Cell ' || idx || ' [' || type || '] status=' || status || ' title="' || title || '"', 'Operation: ' || title || ' columns: a, b', 'Datasets: d1',
  'Execution: inputHash=' || substr(sha256(id), 1, 8) || ' outputHash=' || CASE WHEN idx % 2 = 1 THEN substr(sha256(id), 1, 8) ELSE '—' END, 'Outputs: table:' || title || ' ' || substr(repeat(id, 100), 1, 180), 'Preceding: ' || p, 'Lineage: ' || parent || ', ' || id) AS notebook_context FROM own LEFT JOIN prec USING (notebook_id))"""
NOTEBOOK_CONTEXT = f"WITH {CONTEXT} SELECT query_id, notebook_context FROM ctx"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as records; the conversation is the query, the turn the place."""
    said = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "note").otherwise("notebook_output")
    out = knowledge.records(said, id=F.concat_ws(":", "conv_id", "turn"), kind=kind, text=F.col("text"), workspace=F.col("conv_id"), metadata={}, provenance={}, pos=F.col("turn"))
    return out.withColumn("query_id", F.col("workspace_id")).withColumn("place", F.col("_pos"))


def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for every conversation: replies are the hits, all turns the records of its context."""
    cells, turns = _full_cells(spark, sf_dir), _turns(spark, sf_dir)
    contexts = notebook.contexts(cells, _last_cells(cells))
    return prompt.prompts(turns.select("query_id").distinct(), turns.filter("kind = 'notebook_output'"), turns, contexts, prompt.datasets_header(["d1"]))


_BLANK = "chr(10) || chr(10)"
PROMPT_CONTEXT = f"""WITH {CONTEXT}, turns AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, turn, role, text, CASE WHEN role = 'user' THEN 'note' ELSE 'notebook_output' END AS kind FROM conversations),
 hits AS (SELECT query_id, string_agg('[' || kind || '] ' || text || ' (cell:— ws:' || query_id || ' dataset:—)', {_BLANK} ORDER BY turn) AS h FROM turns WHERE kind = 'notebook_output' GROUP BY query_id),
 fresh AS (SELECT query_id, string_agg('[note] ' || substr(text, 1, 400), {_BLANK} ORDER BY turn) AS e FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn) AS rn FROM turns WHERE kind = 'note') WHERE rn <= 4 GROUP BY query_id)
 SELECT a.query_id, concat_ws({_BLANK}, '[dataset_expert] Current datasetIds: d1', '[notebook_context]' || chr(10) || notebook_context, h, '[notebook_evidence]' || chr(10) || e) AS prompt FROM (SELECT DISTINCT query_id FROM turns) a LEFT JOIN ctx USING (query_id) LEFT JOIN hits USING (query_id) LEFT JOIN fresh USING (query_id)"""


def notebook_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell more in every notebook, a patch, the superseded cells deleted; of the largest notebook all from its third cell superseded."""
    cells = _cells(spark, sf_dir).withColumn("type", F.lit("clean"))
    largest = cells.groupBy("notebook_id").count().orderBy(F.desc("count"), "notebook_id").first()["notebook_id"]
    new = cells.select("notebook_id").distinct().select("notebook_id", F.concat(F.lit("new-"), "notebook_id").alias("id"), F.lit("active").alias("status"), F.lit("markdown").alias("type"))
    longer = notebook.appended(cells, new)
    patched = notebook.updated(longer, new.select("id", F.lit("analysis").alias("type")))
    fewer = notebook.deleted(patched, cells.filter("status = 'superseded'"))
    return notebook.active(notebook.superseded_from(fewer, largest, 3)).select("notebook_id", "id", "idx", "type")


NOTEBOOK_EDITS = f"""WITH {CELLS}, big AS (SELECT notebook_id FROM cells GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 more AS (SELECT notebook_id, id, idx, 'clean' AS type FROM cells WHERE status = 'active' UNION ALL SELECT notebook_id, 'new-' || notebook_id, max(idx) + 1, 'analysis' FROM cells GROUP BY notebook_id),
 again AS (SELECT notebook_id, id, type, CAST(row_number() OVER (PARTITION BY notebook_id ORDER BY idx, id) AS INTEGER) AS idx FROM more) SELECT notebook_id, id, idx, type FROM again WHERE NOT (notebook_id = (SELECT notebook_id FROM big) AND idx >= 3)"""


def ipynb_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back of described cells, their outputs and links from a notebook document."""
    cells = _full_cells(spark, sf_dir).withColumn("source", F.when(F.col("idx") % 4 == 0, F.concat(F.lit("[x] "), "id"))).withColumn("execution_count", F.col("idx").cast("int"))
    cells = cells.withColumn("outputs", F.transform("outputs", lambda o: F.struct(F.when(F.col("idx") % 3 == 0, "error").otherwise(o["type"]).alias("type"), F.concat(o["data"], F.repeat(F.lit("z"), 2000)).alias("data"))))
    notebooks = cells.select(F.col("notebook_id").alias("id")).distinct().withColumn("workspace_id", F.lit("w"))
    back = ipynb.imported(ipynb.exported(notebooks, cells))
    output = F.array_join(F.transform("outputs", lambda o: F.concat_ws(":", o["type"], F.length(o["data"]).cast("string"))), ",")
    return back.select("id", "idx", "type", F.substring_index("source", "\n", 2).alias("source"), "title", "operation", F.array_join("columns", ",").alias("columns"), F.array_join("dataset_ids", ",").alias("dataset_ids"), F.array_join("depends_on", ",").alias("depends_on"), "execution_count", output.alias("outputs"))


IPYNB_CONTENTS = f"""WITH {FULL_CELLS} SELECT id, CAST(idx AS INTEGER) AS idx, CASE WHEN type = 'export' THEN 'transform' ELSE type END AS type,
 CASE WHEN idx % 4 = 0 THEN '[x] ' || id WHEN type = 'markdown' THEN title ELSE '# ' || title || chr(10) || '# cell ' || idx || ' [' || type || '] status=' || status || ' columns: a, b datasets: d1' END AS source, title, title AS operation, 'a,b' AS columns, 'd1' AS dataset_ids, coalesce(parent, '') AS depends_on,
 CASE WHEN type <> 'markdown' THEN CAST(idx AS INTEGER) END AS execution_count, CASE WHEN type = 'markdown' THEN '' WHEN idx % 3 = 0 THEN 'error:0' ELSE 'text:2000' END AS outputs FROM c"""


def notebook_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as notebooks of their nation's workspace: stored, some stored again, one deleted; then each workspace's own."""
    store = stores.NotebookStore(spark, temporary_store(spark, "notebooks"))
    made = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("id"), F.col("c_nationkey").cast("string").alias("workspace_id"), F.col("c_name").alias("title"), F.lit("[]").alias("cells"), F.timestamp_seconds(F.lit(1)).alias("created_at"))
    store.put(made, F.timestamp_seconds(F.lit(2)))
    store.put(made.filter("workspace_id = '3'").withColumn("title", F.lit("again")), F.timestamp_seconds(F.lit(3)))
    first = made.agg(F.min("id")).first()[0]
    store.delete(first)
    rest = store.store.read().select("id", "workspace_id", "title", F.unix_timestamp("updated_at").alias("updated"))
    return rest.unionByName(store.listed("3").select(F.lit("listed").alias("id"), "workspace_id", "title", F.col("id").cast("bigint").alias("updated"))).unionByName(store.get(first).select("id", "workspace_id", "title", F.lit(0).cast("bigint").alias("updated")))


NOTEBOOK_STORE = """WITH n AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id, CAST(c_nationkey AS VARCHAR) AS workspace_id, CASE WHEN c_nationkey = 3 THEN 'again' ELSE c_name END AS title, CAST(CASE WHEN c_nationkey = 3 THEN 3 ELSE 2 END AS BIGINT) AS updated FROM customer WHERE c_custkey <> (SELECT min(c_custkey) FROM customer))
 SELECT * FROM n UNION ALL SELECT 'listed', '3', 'again', CAST(min(id) AS BIGINT) FROM n WHERE workspace_id = '3' HAVING count(*) > 0"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: datasets are their sources, columns their languages."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    status = F.when(F.col("doc_id") % 5 == 0, "superseded").when(F.col("doc_id") % 5 > 1, "active")
    kind = F.when(F.col("doc_id") % 3 == 0, "note").when(F.col("doc_id") % 3 == 1, "statistic").otherwise("guide")
    return knowledge.records(d, id=F.col("doc_id"), kind=kind, text=F.col("text"), workspace=F.lit("w"), dataset=F.col("source"), cell=F.concat(F.lit("c"), (F.col("doc_id") % 50).cast("string")), metadata={"status": status, "column": F.col("lang")}, provenance={}, pos=F.col("doc_id"))


_FIRSTS = "f AS (SELECT min(source) AS s, max(source) AS t, min(lang) AS l FROM documents)"
_KIND = "CASE doc_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'notebook_output' ELSE 'guide' END"


def _firsts(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "documents").agg(F.min("source"), F.max("source"), F.min("lang")).first()


def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that every filter of a search passes, and those of a request without a scope."""
    first, last, lang = _firsts(spark, sf_dir)
    request = search.Request(workspace_id="w", kinds=("notebook_output", "guide"), dataset_ids=(first, last), column=lang).normalized("what is there")
    docs = knowledge.normalized(_documents(spark, sf_dir))
    nowhere = search.candidates(docs, search.Request())
    return search.filtered(search.candidates(docs, request), request).unionByName(nowhere).select("id", "kind", "dataset_id")


SEARCH_FILTERS = f"WITH {_FIRSTS} SELECT CAST(doc_id AS VARCHAR) AS id, {_KIND} AS kind, source AS dataset_id FROM documents, f WHERE doc_id % 3 <> 0 AND source IN (s, t) AND lang = l AND doc_id % 5 <> 0"


def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query without text gives the first records, all with one score."""
    return search.search(_documents(spark, sf_dir), "  ", search.Request(scope="all", limit=20, include_system=False)).select("id", "kind", "score", "place")


FIRST_CANDIDATES = f"SELECT CAST(doc_id AS VARCHAR) AS id, {_KIND} AS kind, CAST(0.5 AS DOUBLE) AS score, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS place FROM documents WHERE doc_id % 5 <> 0 ORDER BY doc_id LIMIT 20"


def search_without_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedder that fails on a text gives the first records too; a provider that fails gives nothing."""

    def failing(texts):
        if texts != ["what is there"]:
            raise RuntimeError("no model")
        return [[1.0]]

    memo = providers.RequestMemo(spark, "w")
    nothing = memo.get("lost", lambda session, workspace: session.read.parquet(f"{sf_dir}/no such table"))
    found = search.search(_documents(spark, sf_dir), "what is there", search.Request(scope="all", limit=20, include_system=False), failing, extra=[nothing])
    return found.select("id", "kind", "score", "place")


def record_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records stored, a third stored again, some removed by id and by cell; then looked up by dataset, column, cell and hash."""
    first, _, lang = _firsts(spark, sf_dir)
    store = knowledge_store.KnowledgeStore(spark, temporary_store(spark, "records"))
    docs = _documents(spark, sf_dir)
    store.put(docs)
    store.put(docs.filter("kind = 'note'").withColumn("text", F.lit("again")))
    store.remove("1", "2")
    store.remove_cell("c7")
    looked = {"dataset": store.by_dataset(first), "column": store.by_column(lang), "cell": store.by_cell("c9"), "workspace": store.by_workspace("w"), "none": store.by_notebook("nb")}
    out = None
    for name, rows in looked.items():
        rows = rows.select(F.lit(name).alias("lookup"), "id", "kind", F.sha2("text", 256).alias("text_sha256"))
        out = rows if out is None else out.unionByName(rows)
    return out


RECORD_STORE = f"""WITH {_FIRSTS}, r AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, {_KIND} AS kind, sha256(CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE text END) AS text_sha256, source, lang FROM documents WHERE doc_id NOT IN (1, 2) AND doc_id % 50 <> 7)
 SELECT 'dataset' AS lookup, id, kind, text_sha256 FROM r, f WHERE source = s UNION ALL SELECT 'column', id, kind, text_sha256 FROM r, f WHERE lang = l UNION ALL SELECT 'cell', id, kind, text_sha256 FROM r WHERE doc_id % 50 = 9 UNION ALL SELECT 'workspace', id, kind, text_sha256 FROM r"""


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two owners stored, one content deleted; what the first owner has, and its nearest to a vector."""
    store = knowledge_store.VectorStore(spark, temporary_store(spark, "vectors"))
    e = table(spark, sf_dir, "embeddings")
    uid = F.when(F.col("vec_id") % 2 == 0, "u").otherwise("v")
    store.upsert(e.select(F.col("label").cast("string").alias("content_hash"), F.col("vec_id").cast("string").alias("id"), F.lit("w").alias("workspace_id"), F.lit("note").alias("kind"), F.lit("t").alias("text"), "embedding", F.timestamp_seconds("vec_id").alias("used_at"), uid.alias("uid")))
    gone, query = e.agg(F.min("label")).first()[0], list(e.filter("vec_id = 0").first()["embedding"])
    store.delete_content("u", str(gone))
    near = store.search("u", query, 5, kinds=("note",)).select(F.lit("near").alias("what"), "key")
    return store.all("u", "w").select(F.lit("all").alias("what"), "key").unionByName(near)


VECTOR_STORE = """WITH v AS (SELECT 'u:vector:' || label || ':' || vec_id AS key, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings WHERE vec_id % 2 = 0 AND label <> (SELECT min(label) FROM embeddings))
 SELECT 'all' AS what, key FROM v UNION ALL SELECT * FROM (SELECT 'near', key FROM v ORDER BY s DESC, key LIMIT 5)"""


def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored by model and text, one model invalidated; what is found for all passages under both."""
    cache = knowledge_store.EmbeddingCache(spark, temporary_store(spark, "embeddings"))
    passages = table(spark, sf_dir, "benchmark").groupBy("text").agg(F.min("item_id").alias("vec_id"))
    vectors = passages.join(table(spark, sf_dir, "embeddings"), "vec_id").select("text", F.col("embedding").alias("vector"))
    for model in ("kept", "dropped"):
        cache.set(model, vectors)
    cache.invalidate("dropped")
    found = [cache.get(model, table(spark, sf_dir, "benchmark")).select(F.lit(model).alias("model"), "text", F.size("vector").alias("width"), F.get("vector", F.lit(0)).alias("first")) for model in ("kept", "dropped")]
    return found[0].unionByName(found[1])


EMBEDDING_CACHE = "SELECT 'kept' AS model, text, CAST(len(embedding) AS INTEGER) AS width, embedding[1] AS first FROM (SELECT text, min(item_id) AS vec_id FROM benchmark GROUP BY text) JOIN embeddings USING (vec_id)"

OUTPUTS = ("diff", "table", "chart", "metric", "error", "text", "dataset", "file", "other")


def output_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and kinds of the outputs of events, one of each type in turn; unknown types have none."""
    e = table(spark, sf_dir, "events")
    n, odd = F.col("event_id"), F.col("event_id") % 2 == 1
    data = F.to_json(F.struct(F.when(odd, n % 5).alias("rowsRemoved"), (n % 3).alias("valuesChanged"), F.col("event_type").alias("fileName"), F.lit("bar").alias("chartType")))
    output = F.struct(F.get(F.array(*map(F.lit, OUTPUTS)), (n % len(OUTPUTS)).cast("int")).alias("type"), F.when(odd, F.col("event_type")).alias("title"), F.when(odd, n).alias("row_count"), F.when(odd, F.array(F.lit("a"), F.lit("b"))).alias("columns"), F.lit(None).cast("string").alias("chart_type"), data.alias("data"))
    rows = e.select("event_id", F.struct(F.col("user_id").alias("idx")).alias("cell"), output.alias("output"))
    return rows.select("event_id", knowledge.output_narrative().alias("text"), knowledge.output_kind(F.col("output.type")).alias("kind"))


_TITLED = "CASE WHEN odd THEN ' \"' || event_type || '\"' ELSE '' END"
_CHANGES = "concat_ws(', ', CASE WHEN odd AND event_id % 5 <> 0 THEN event_id % 5 || ' rows removed' END, CASE WHEN event_id % 3 <> 0 THEN event_id % 3 || ' values changed' END)"
_DATA = """'{' || CASE WHEN odd THEN '"rowsRemoved":' || event_id % 5 || ',' ELSE '' END || '"valuesChanged":' || event_id % 3 || ',"fileName":"' || event_type || '","chartType":"bar"}'"""
_ROWS = "CASE WHEN odd THEN CAST(event_id AS VARCHAR) ELSE '?' END"
OUTPUT_NARRATIVES = f"""WITH e AS (SELECT *, event_id % 2 = 1 AS odd, event_id % {len(OUTPUTS)} AS k FROM events), x AS (SELECT *, {_TITLED} AS title, {_CHANGES} AS changes, {_DATA} AS data FROM e)
 SELECT event_id, 'Cell ' || user_id || CASE k WHEN 0 THEN CASE WHEN changes = '' THEN ' produced a diff.' ELSE ' diff' || title || ': ' || changes || '.' END WHEN 1 THEN ' table' || title || ' with ' || {_ROWS} || ' rows, columns ' || CASE WHEN odd THEN 'a, b' ELSE '' END || '.'
  WHEN 2 THEN ' chart' || title || ' type bar ' || CASE WHEN odd THEN 'for a, b' ELSE '' END || '.' WHEN 3 THEN ' metric' || title || ': ' || data WHEN 4 THEN ' error' || title || ': ' || data WHEN 5 THEN ' note' || title || ': ' || data
  WHEN 6 THEN ' dataset' || title || ': ' || {_ROWS} || ' rows.' WHEN 7 THEN ' file' || title || ': ' || event_type END AS text, CASE k WHEN 2 THEN 'notebook_visualization' WHEN 4 THEN 'error' ELSE 'notebook_output' END AS kind FROM x"""

CATALOGUE_QUERY = "red gear, large or ECONOMY"


def catalogue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context lines of the capabilities nearest to a query: parts are the methods, brands their groups, passages the guides."""
    part, asked = table(spark, sf_dir, "part"), table(spark, sf_dir, "benchmark")
    methods = part.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("label"), F.col("p_brand").alias("group"), F.col("p_type").alias("summary"), F.col("p_partkey").alias("place"))
    groups = part.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("group"), F.concat(F.lit("Group "), "p_brand").alias("label"), F.lower("p_brand").alias("ui_path"))
    guides = asked.select(F.concat(F.lit("g"), F.col("item_id").cast("string")).alias("key"), F.lit("guide").alias("kind"), F.lit("Guide").alias("name"), F.lit("large").alias("family"), F.col("text").alias("about"), F.lit("upload").alias("ui_path"), F.col("item_id").alias("place"))
    flags = part.filter("p_size <= 3").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("key"))
    found = providers.corpus_provider(knowledge.corpus(methods, groups, guides, flags), CATALOGUE_QUERY, 100)(spark, "w")
    return found.select("id", "kind", prompt.context_line().alias("line"))


_HITS = " + ".join(f"CAST(contains(lower(name || ' ' || family || ' ' || about), '{t}') AS INTEGER)" for t in tokens_of(CATALOGUE_QUERY))
CATALOGUE_LINES = f"""WITH g AS (SELECT p_brand, 'Group ' || p_brand AS label, lower(p_brand) AS ui FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand),
 c AS (SELECT 'm' || p_partkey AS key, 'functionality' AS kind, p_name AS name, coalesce(label, p_brand) AS family, p_type || ' Find it at ' || coalesce(ui, 'analyse') || '.' || CASE WHEN p_size <= 3 THEN ' Note: experimental, its verification is pending.' ELSE '' END AS about, coalesce(ui, 'analyse') AS ui, p_size > 3 AS verified, 0 AS late, p_partkey AS place FROM part LEFT JOIN g USING (p_brand)
  UNION ALL SELECT 'g' || item_id, 'guide', 'Guide', 'large', text, 'upload', true, 1, item_id FROM benchmark)
 SELECT 'func::' || key AS id, kind, '[' || kind || '] ' || name || ' (' || family || '): ' || about || ' (ref: functionality:' || key || ' ui:' || ui || CASE WHEN verified THEN '' ELSE ' experimental-verification-pending' END || ')' AS line FROM c ORDER BY {_HITS} DESC, late, place LIMIT 100"""


def _words(text: str) -> list[str]:
    return text.split(" ")


def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 512 tokens of whole documents, by a tokenizer that cuts at blanks."""
    pieces = providers.token_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", _words, " ".join)
    return pieces.select("doc_id", "chunk", F.sha2("text", 256).alias("text_sha256"))


TOKEN_CHUNKS = f"""WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS t FROM documents), n AS (SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(0, len(t) - {providers.CHUNK_TOKENS}) / {providers.CHUNK_TOKENS - providers.TOKEN_OVERLAP}) AS BIGINT))) AS k FROM w)
 SELECT doc_id, CAST(k AS INTEGER) AS chunk, sha256(array_to_string(t[k * {providers.CHUNK_TOKENS - providers.TOKEN_OVERLAP} + 1 : k * {providers.CHUNK_TOKENS - providers.TOKEN_OVERLAP} + {providers.CHUNK_TOKENS}], ' ')) AS text_sha256 FROM n"""

SIZED = ("region", "customer", "supplier", "orders", "lineitem", "events")


def sample_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table a sample takes, by either rule."""
    rows = []
    for name in SIZED:
        n = table(spark, sf_dir, name).count()
        (mode, size), said = sampling.selection(n), sampling.sample_metadata(n)
        rows.append((name, mode, size, said["coverage"], said["n"]))
    return spark.createDataFrame(rows, "name string, mode string, size int, coverage string, said int")


SAMPLE_POLICY = (
    "WITH s AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in SIZED)
    + ") SELECT name, CASE WHEN n <= 1000 THEN 'exact' ELSE 'representative' END AS mode, CAST(CASE WHEN n <= 1000 THEN n WHEN n <= 5000 THEN least(400 + n // 10, 1000) ELSE 200 END AS INTEGER) AS size, CASE WHEN n BETWEEN 1 AND 200 THEN 'exact' ELSE 'sample' END AS coverage, CAST(least(200, n) AS INTEGER) AS said FROM s"
)

QUERIES = {
    "notebook_context": (notebook_context, NOTEBOOK_CONTEXT),
    "prompt_context": (prompt_context, PROMPT_CONTEXT),
    "notebook_edits": (notebook_edits, NOTEBOOK_EDITS),
    "ipynb_contents": (ipynb_contents, IPYNB_CONTENTS),
    "notebook_store": (notebook_store, NOTEBOOK_STORE),
    "search_filters": (search_filters, SEARCH_FILTERS),
    "search_without_model": (search_without_model, FIRST_CANDIDATES),
    "first_candidates": (first_candidates, FIRST_CANDIDATES),
    "record_store": (record_store, RECORD_STORE),
    "vector_store": (vector_store, VECTOR_STORE),
    "embedding_cache": (embedding_cache, EMBEDDING_CACHE),
    "output_narratives": (output_narratives, OUTPUT_NARRATIVES),
    "catalogue_lines": (catalogue_lines, CATALOGUE_LINES),
    "token_chunks": (token_chunks, TOKEN_CHUNKS),
    "sample_policy": (sample_policy, SAMPLE_POLICY),
}
