"""Queries on samples, records, stores, notebooks and conversations, and their SQL."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.coerce import js_round
from quillmark.operators import knowledge, notebook, profile, prompt, providers, sampling
from quillmark.operators.profile import DatasetSpec
from quillmark.plans.common import GAPS_SQL, missing_sql, orders_with_gaps, rounded_sql, table
from quillmark.plans.profiling import GAP_COLUMNS
from quillmark.sources import ipynb, stores

ORDERS = DatasetSpec("orders.csv", order=("o_orderkey",))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their place by key."""
    return sampling.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate"), ["o_orderkey"])


NUMBERED = "n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos, count(*) OVER () AS total FROM orders)"


def sample_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numbered(spark, sf_dir)
    return sampling.head_tail(df, "_pos", df.count(), 200).select("_pos", "o_orderkey")


SAMPLE_HEAD_TAIL = f"WITH {NUMBERED} SELECT _pos, o_orderkey FROM n WHERE _pos < 15 OR _pos >= total - 15"


def sample_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quantile_rows(_numbered(spark, sf_dir), "_pos", "o_totalprice", 170)


SAMPLE_QUANTILE = f"WITH {NUMBERED}, r AS (SELECT _pos AS pos, row_number() OVER (ORDER BY o_totalprice, _pos) - 1 AS rank, total FROM n) SELECT pos, rank FROM r WHERE rank % greatest(1, total // 170) = 0"


def sample_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numbered(spark, sf_dir).withColumn("day", F.date_format("o_orderdate", "yyyy-MM"))
    return sampling.rare_rows(df, "_pos", "day")


SAMPLE_RARE = f"WITH {NUMBERED} SELECT strftime(o_orderdate, '%Y-%m') AS value, count(*) AS count, min(_pos) AS pos FROM n GROUP BY 1 ORDER BY 2, min(_pos) LIMIT 5"


def sample_lcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numbered(spark, sf_dir)
    n = df.count()
    positions = sampling.sample_positions(df, "_pos", n, sampling.SAMPLE_N, sampling.seed_of("orders", "c"), "o_totalprice", "o_orderpriority")
    return sampling.rows_at(df, "_pos", positions).select("place", "_pos", "o_orderkey")


def row_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    text = T.row_text(["n_nationkey", "n_name", "n_regionkey"])
    return df.select("n_nationkey", text.alias("text"), T.chunk_hash(F.lit("c"), F.col("n_nationkey"), text).alias("chunk_hash"))


_ROW = "concat('n_nationkey: ', n_nationkey, ' | n_name: ', n_name, ' | n_regionkey: ', n_regionkey)"
ROW_TO_TEXT = f"SELECT n_nationkey, {_ROW} AS text, substr(sha256(concat('c:', n_nationkey, ':', substr({_ROW}, 1, 50))), 1, 12) AS chunk_hash FROM nation"


def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", T.source_hash(F.col("text")).alias("source_hash"), T.embedding_key(F.lit("model"), F.col("text")).alias("embedding_key"), js_round(T.token_estimate(F.col("text")), 2).alias("tokens"))


SOURCE_HASH = "SELECT doc_id, substr(sha256(text), 1, 16) AS source_hash, 'model:v1:' || substr(sha256(text), 1, 16) AS embedding_key, floor(length(text) / 4.0 * 100 + 0.5) / 100 AS tokens FROM documents"


def column_semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_size", "p_retailprice")
    spec = DatasetSpec("part.csv")
    stats = profile.numeric_profile(df, spec).join(profile.column_counts(df, df.columns), "column").withColumn("kind", F.lit("numeric"))
    return stats.select("column", knowledge.rich_text(True).alias("text"), knowledge.header_text(F.col("column"), F.col("kind")).alias("header"))


def _column_text(c: str) -> str:
    two = lambda x, d=2: f"printf('%.{d}f', {rounded_sql(x, d)})"
    m3 = lambda x: rounded_sql(x, 3)
    return f"""SELECT '{c}' AS "column", concat('Column "{c}" (numeric): missing 0.0% unique ', u, ', mean ', {two(m3("mean"))}, ', median ', {two(m3("med"))}, ', std ', {two(m3("s"))}, ', skew ', {two(m3("sk"))}) AS text, 'Column "{c}" is numeric' AS header
 FROM (SELECT count(DISTINCT {c}) AS u, any_value(m.mean) AS mean, median({c}) AS med, any_value(m.s) AS s, sum(power(({c} - m.mean) / m.s, 3)) / count(*) AS sk FROM part, (SELECT avg({c}) AS mean, stddev_samp({c}) AS s FROM part) m)"""


COLUMN_TEXT = _column_text("p_size") + " UNION ALL " + _column_text("p_retailprice")


def relationship_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = providers.relationship_provider(orders_with_gaps(spark, sf_dir), ORDERS, "d")(spark, "w")
    return made.select("id", "kind", "text")


_GAP_PAIRS = [(a, b) for i, a in enumerate(GAP_COLUMNS[1:]) for b in GAP_COLUMNS[i + 2 :]]
_NOTED = "'Relationship: columns \"' || a || '\" and \"' || b || '\" tend to be missing together (correlation ' || printf('%.2f', raw) || ') in dataset d'"
#: Of these columns only the key and the price have values enough to make a composite key.
RELATIONSHIP_RECORDS = (
    f"WITH {GAPS_SQL}, p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rounded_sql(f'count(*) FILTER (WHERE {missing_sql(a)} AND {missing_sql(b)}) / sqrt(CAST(count(*) FILTER (WHERE {missing_sql(a)}) AS DOUBLE) * count(*) FILTER (WHERE {missing_sql(b)}))', 2)} AS raw, count(*) FILTER (WHERE {missing_sql(a)} AND {missing_sql(b)}) / sqrt(CAST(count(*) FILTER (WHERE {missing_sql(a)}) AS DOUBLE) * count(*) FILTER (WHERE {missing_sql(b)})) AS exact FROM gaps" for a, b in _GAP_PAIRS)
    + f"""), head AS (SELECT * FROM gaps ORDER BY o_orderkey LIMIT 5000), dup AS (SELECT coalesce(sum(c), 0) - count(*) AS n, sum(c) AS looked FROM (SELECT count(*) AS c FROM head GROUP BY o_orderkey, priority, status, custkey, totalprice)),
 texts AS (SELECT 'missingTogether:' || a || ':' || b AS id, {_NOTED} AS text FROM p WHERE exact > 0.3
  UNION ALL SELECT 'candidateKeys', 'Relationship: candidate key columns [o_orderkey] uniquely identify rows in dataset d (duplicate ' || printf('%g', round(100.0 * n / looked, 2)) || '% ' || n || ' rows)' FROM dup WHERE (SELECT count(DISTINCT o_orderkey) = count(*) FROM gaps)
  UNION ALL SELECT 'composite:o_orderkey_totalprice', 'Relationship: composite key [o_orderkey, totalprice] uniquely identifies rows in dataset d' FROM (SELECT count(DISTINCT coalesce(CAST(totalprice AS VARCHAR), '')) AS d, count(*) AS n, (SELECT count(DISTINCT (o_orderkey, coalesce(CAST(totalprice AS VARCHAR), ''))) = count(*) FROM head) AS ok FROM gaps) WHERE ok AND d / CAST(n AS DOUBLE) > 0.5
  UNION ALL SELECT 'highMissing', 'Relationship: columns with high missing rate in d: ' || list || ' (avg missing per row ' || printf('%.1f', average) || ')' FROM (SELECT (SELECT string_agg(c, ', ' ORDER BY k) FROM ("""
    + " UNION ALL ".join(f"SELECT {k} AS k, '{c}' AS c, 100.0 * count(*) FILTER (WHERE {missing_sql(c)}) / count(*) AS pct FROM gaps" for k, c in enumerate(GAP_COLUMNS))
    + f") WHERE pct > 20) AS list, (SELECT {rounded_sql('avg(' + ' + '.join(f'CAST({missing_sql(c)} AS INTEGER)' for c in GAP_COLUMNS) + ')', 2)} FROM gaps) AS average) WHERE list IS NOT NULL)\n SELECT 'rel:d:' || id AS id, 'relationship' AS kind, text FROM texts"
)


def short_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short forms of profile, column and relation records."""
    return providers.plain_records(orders_with_gaps(spark, sf_dir), ORDERS, "d")(spark, "w").select("id", "kind", "text")


_GAP_KINDS = ("numeric", "categorical", "categorical", "numeric", "numeric")
SHORT_RECORDS = (
    RELATIONSHIP_RECORDS[: RELATIONSHIP_RECORDS.index(" texts AS (")]
    + """ texts AS (SELECT 'dataset:d:profile' AS id, 'dataset_profile' AS kind, 'Dataset orders.csv profile: ' || (SELECT count(*) FROM gaps) || ' rows x5 cols, duplicate 0% (0 rows)' AS text
  UNION ALL SELECT 'dataset:d:rel:missingTogether:' || a || ':' || b, 'relationship', 'Relationship: columns "' || a || '" and "' || b || '" missing together (correlation ' || printf('%.2f', raw) || ') in d' FROM p WHERE exact > 0.3 UNION ALL """
    + " UNION ALL ".join(f"SELECT 'dataset:d:col:{c}', 'column_semantic', 'Column {c} ({k}): unique ' || count(DISTINCT {c}) FILTER (WHERE NOT {missing_sql(c)}) || ' missing ' || printf('%g', {rounded_sql(f'100.0 * count(*) FILTER (WHERE {missing_sql(c)}) / count(*)', 2)}) || '%' FROM gaps" for c, k in zip(GAP_COLUMNS, _GAP_KINDS, strict=True))
    + ") SELECT id, kind, text FROM texts"
)


def dataset_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dataset provider says of customers before they are profiled, but for its sample; some rows come twice, some are empty."""
    c = table(spark, sf_dir, "customer")
    planted = c.filter("c_custkey % 100 = 0")
    df = c.unionByName(planted).unionByName(planted.select(*(F.lit(None).cast(t).alias(n) for n, t in c.dtypes))).withColumn("same", F.when(F.col("c_custkey").isNotNull(), "x"))
    spec = DatasetSpec("customer.csv", order=("c_custkey",))
    made = providers.dataset_provider(df, spec, "d", objective="find groups", profiled=False)(spark, "w")
    return made.filter("kind != 'data_representative'").select("id", "kind", "text", "source_hash")


_COLUMNS = (("c_custkey", "numeric"), ("c_name", "categorical"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("c_mktsegment", "categorical"), ("same", "categorical"))
_LISTED = ", ".join(f"{c} ({k})" for c, k in _COLUMNS)
DATASET_RECORDS = (
    f"""WITH planted AS (SELECT count(*) AS p FROM customer WHERE c_custkey % 100 = 0), n AS (SELECT count(*) + 2 * any_value(p) AS n, any_value(p) AS p FROM customer, planted),
 head AS (SELECT count(*) AS looked, count(*) - count(DISTINCT coalesce(CAST(k AS VARCHAR), 'none')) AS repeated FROM (SELECT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT NULL FROM customer WHERE c_custkey % 100 = 0) ORDER BY k NULLS FIRST LIMIT 5000)),
 texts AS (SELECT 'description' AS id, 'dataset_profile' AS kind, DESCRIPTION AS text FROM n UNION ALL SELECT 'profile', 'dataset_profile', 'RAG dataset profile: ' || n || ' rows ×6 cols (customer.csv), duplicate ' || printf('%g', floor(100.0 * repeated / looked * 100 + 0.5) / 100) || '% (' || repeated || ' rows), empty rows ' || p || ', constant cols: same, types: numeric:3, categorical:3' FROM n, head
  UNION ALL """
    + " UNION ALL ".join(f"SELECT 'col:{c}', 'column_semantic', 'Column \"{c}\" is {k}'" for c, k in _COLUMNS)
    + ") SELECT 'dataset:d:' || id AS id, kind, text, substr(sha256(text), 1, 16) AS source_hash FROM texts"
).replace("DESCRIPTION", f"'Dataset \"customer.csv\" purpose: find groups has ' || n || ' rows and 6 columns. Types: numeric:3, categorical:3. Columns: {_LISTED}.'")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    old, new = events.filter("event_id % 3 <> 0"), events.filter("event_id % 3 = 0")
    last = lambda df: stores.latest(df, "user_id", ["event_id"])
    return stores.upserted(last(old), last(new), "user_id")


UPSERT_LATEST = """WITH r AS (SELECT user_id, event_id, event_type, event_id % 3 = 0 AS fresh FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fresh DESC, event_id DESC) AS rn FROM r) SELECT user_id, event_id, event_type FROM l WHERE rn = 1"""


def union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("origin"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("origin"))
    return knowledge.union_first(s, c, p)


UNION_DEDUP = """SELECT s_suppkey AS id, 'supplier' AS origin FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
 UNION ALL SELECT p_partkey, 'part' FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) AND p_partkey NOT IN (SELECT c_custkey FROM customer)"""


def lru_evict_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.trimmed_by_count(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 500).select("event_id")


LRU_COUNT = "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500"


def lru_evict_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.lit(None).cast("array<float>").alias("vector"))
    return stores.trimmed_by_bytes(docs, stores.entry_bytes(F.col("vector"), F.col("text")), "doc_id", "doc_id", 10_000, 60_000, owner="source").select("doc_id", "source")


LRU_BYTES = """WITH s AS (SELECT doc_id, source, 2 * length(text) + 300 AS size FROM documents), w AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, sum(size) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn,
 sum(size) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM s) SELECT doc_id, source FROM w WHERE (n <= 10000 AND total <= 60000) OR (rn <= 8000 AND running <= 48000)"""


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt.history_window(table(spark, sf_dir, "conversations"), limit=4, head=1).select("conv_id", "turn")


HISTORY_WINDOW = "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 4 OR rn <= 1 OR rn > n - 3"


def fold_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt.folded(table(spark, sf_dir, "conversations"))


FOLD_HISTORY = "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) || chr(10) ORDER BY turn) AS history FROM conversations WHERE trim(text) <> '' GROUP BY conv_id"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cells: a notebook for each user; a cell depends on the one before it of the same type."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    by, same = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id", "event_type").orderBy("event_id")
    before = F.lag("event_id").over(same)
    return e.select(
        F.concat(F.lit("nb_"), F.col("user_id").cast("string")).alias("notebook_id"), F.col("event_id").cast("string").alias("id"), F.row_number().over(by).alias("idx"),
        F.when(F.col("event_id") % 6 == 0, "superseded").otherwise("active").alias("status"), F.array_compact(F.array(before.cast("string"))).alias("depends_on"),
    )


CELLS = """cells AS (SELECT 'nb_' || user_id AS notebook_id, CAST(event_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, CASE WHEN event_id % 6 = 0 THEN 'superseded' ELSE 'active' END AS status,
 CAST(lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS VARCHAR) AS parent FROM events)"""


def preceding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "events").groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()["user_id"]
    return notebook.preceding(_cells(spark, sf_dir), f"nb_{first}", 9).select("id", "idx")


PRECEDING_CELLS = f"WITH {CELLS}, u AS (SELECT 'nb_' || user_id AS nb FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1) SELECT id, CAST(idx AS INTEGER) AS idx FROM cells, u WHERE notebook_id = nb AND idx < 9 AND status <> 'superseded' ORDER BY idx DESC LIMIT 5"


def mark_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    first = cells.agg(F.min_by("id", F.col("id").cast("bigint"))).first()[0]
    return notebook.stale_dependents(cells, first)


MARK_STALE = f"WITH RECURSIVE {CELLS}, reach AS (SELECT id, 0 AS depth FROM cells WHERE CAST(id AS BIGINT) = (SELECT min(event_id) FROM events) UNION ALL SELECT c.id, depth + 1 FROM cells c JOIN reach r ON c.parent = r.id) SELECT r.id FROM reach r JOIN cells c ON c.id = r.id WHERE depth > 0 AND c.status = 'active'"


def notebook_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of synthetic notebooks, without times."""
    e = table(spark, sf_dir, "events")
    cells = _cells(spark, sf_dir).join(e.select(F.col("event_id").cast("string").alias("id"), "event_type", F.col("ts").alias("created_at")), "id")
    kinds = F.array(*map(F.lit, ("upload", "clean", "analysis", "export", "markdown")))
    full = cells.select(
        "notebook_id", "id", "idx", F.get(kinds, F.col("idx") % 5).alias("type"), "status", F.array(F.lit("d1")).alias("dataset_ids"), F.col("event_type").alias("operation"), F.array(F.lit("a"), F.lit("b")).alias("columns"), F.col("event_type").alias("markdown"),
        F.array().cast("array<string>").alias("source_cell_ids"), "depends_on", F.array().cast("array<struct<id:string,type:string,title:string,row_count:bigint,columns:array<string>,chart_type:string,data:string>>").alias("outputs"), "created_at",
    )
    notebooks = full.select(F.col("notebook_id").alias("id")).distinct().withColumn("workspace_id", F.substring("id", 4, 20))
    return knowledge.notebook_records(notebooks, full).select("id", "kind", "text", "source_hash")


NOTEBOOK_SUMMARIES = f"""WITH {CELLS}, c AS (SELECT cells.*, event_type AS op, CASE idx % 5 WHEN 0 THEN 'upload' WHEN 1 THEN 'clean' WHEN 2 THEN 'analysis' WHEN 3 THEN 'export' ELSE 'markdown' END AS type, CASE WHEN status = 'superseded' THEN ' (superseded, historical)' ELSE '' END AS st FROM cells JOIN events e ON cells.id = CAST(e.event_id AS VARCHAR)),
 t AS (SELECT id || '::narrative' AS id, 'notebook_cell' AS kind, 'Cell ' || idx || CASE type WHEN 'upload' THEN ' [upload]' || st || ' loaded dataset d1.' WHEN 'export' THEN ' [export]' || st || ' exported dataset d1.' WHEN 'markdown' THEN ' [note]' || st || ': ' || op ELSE ' [' || type || ']' || st || ' operation ' || op || ' columns a, b on dataset d1.' END AS text, '' AS more FROM c
  UNION ALL SELECT id || '::col:' || col, 'column_semantic', 'Cell ' || idx || ' ' || op || ' affected column "' || col || '" on dataset d1.', '' FROM c, (VALUES ('a'), ('b')) v(col) WHERE type = 'clean'
  UNION ALL SELECT notebook_id || '::summary', 'dataset_profile', 'Workspace ' || substr(notebook_id, 4) || ' notebook contains ' || count(*) || ' cells, datasets: d1.', notebook_id FROM c GROUP BY notebook_id)
 SELECT id, kind, text, substr(sha256(text || more), 1, 16) AS source_hash FROM t"""


def ipynb_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).withColumn("type", F.when(F.col("idx") % 3 == 0, "markdown").when(F.col("idx") % 3 == 1, "clean").otherwise("visualization")).withColumn("source", F.concat(F.lit("s"), "id")).withColumn("outputs", F.lit(None).cast("array<struct<type:string,data:string>>"))
    notebooks = cells.select(F.col("notebook_id").alias("id")).distinct().withColumn("workspace_id", F.lit("w"))
    return ipynb.imported(ipynb.exported(notebooks, cells)).select("notebook_id", "id", "idx", "type", "status", "source")


IPYNB = f"WITH {CELLS} SELECT notebook_id, id, CAST(idx AS INTEGER) AS idx, CASE idx % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'clean' ELSE 'transform' END AS type, status, 's' || id AS source FROM cells"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First user turns as cached queries, a second apart; vectors by number."""
    said = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    vectors = table(spark, sf_dir, "embeddings")
    return said.join(vectors, F.col("conv_id") == F.col("vec_id")).select("conv_id", F.lit("w").alias("workspace"), F.lit("m").alias("model"), "query", F.concat(F.lit("reply "), F.col("conv_id").cast("string")).alias("reply"), F.timestamp_seconds(F.col("conv_id")).alias("at"), F.col("embedding").alias("vector"))


def reply_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    now = F.timestamp_seconds(F.lit(350))
    known = prompt.live(entries.filter("conv_id % 2 = 0").drop("conv_id"), now)
    asked = entries.select(F.col("conv_id").alias("query_id"), "workspace", "model", F.concat(F.lit("  "), F.translate("query", ascii_lowercase, ascii_uppercase)).alias("query"), "vector")
    exact = prompt.exact_hits(asked, known).withColumn("how", F.lit("exact"))
    similar = prompt.similar_hits(asked, known).select("query_id", "reply", F.lit("similar").alias("how"))
    return exact.unionByName(similar)


REPLY_CACHE = r"""WITH said AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
 entries AS (SELECT conv_id, 'reply ' || conv_id AS reply, conv_id AS made, CAST(embedding AS DOUBLE[]) AS vector, trim(regexp_replace(lower(query), '\s+', ' ', 'g')) AS key FROM said JOIN embeddings ON conv_id = vec_id),
 renewed AS (SELECT *, coalesce(made - lag(made) OVER (PARTITION BY key ORDER BY made) > 300, true) AS again FROM entries WHERE conv_id % 2 = 0),
 starts AS (SELECT *, max(CASE WHEN again THEN made END) OVER (PARTITION BY key ORDER BY made) AS start FROM renewed),
 latest AS (SELECT key, max(start) AS first_at, max(made) AS made, arg_max(reply, made) AS reply, arg_max(vector, made) AS vector FROM starts GROUP BY key),
 live AS (SELECT * FROM (SELECT * FROM latest ORDER BY first_at DESC, key LIMIT 100) WHERE 350 - made <= 300),
 near AS (SELECT a.conv_id AS query_id, l.reply, list_cosine_similarity(a.vector, l.vector) AS s, l.made FROM entries a, live l)
 SELECT a.conv_id AS query_id, l.reply, 'exact' AS how FROM entries a JOIN live l USING (key) UNION ALL
 SELECT query_id, reply, 'similar' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, made DESC, reply DESC) AS rn FROM near WHERE s >= 0.95) WHERE rn = 1"""

QUERIES = {
    "sample_head_tail": (sample_head_tail, SAMPLE_HEAD_TAIL),
    "sample_quantile": (sample_quantile, SAMPLE_QUANTILE),
    "sample_rare": (sample_rare, SAMPLE_RARE),
    "sample_lcg": (sample_lcg, None),
    "row_to_text": (row_to_text, ROW_TO_TEXT),
    "source_hash": (source_hash, SOURCE_HASH),
    "column_semantic_text": (column_semantic_text, COLUMN_TEXT),
    "relationship_records": (relationship_records, RELATIONSHIP_RECORDS),
    "short_records": (short_records, SHORT_RECORDS),
    "dataset_records": (dataset_records, DATASET_RECORDS),
    "upsert_latest": (upsert_latest, UPSERT_LATEST),
    "union_dedup": (union_dedup, UNION_DEDUP),
    "lru_evict_count": (lru_evict_count, LRU_COUNT),
    "lru_evict_bytes": (lru_evict_bytes, LRU_BYTES),
    "history_window": (history_window, HISTORY_WINDOW),
    "fold_history": (fold_history, FOLD_HISTORY),
    "preceding_cells": (preceding_cells, PRECEDING_CELLS),
    "mark_stale": (mark_stale, MARK_STALE),
    "notebook_records": (notebook_summaries, NOTEBOOK_SUMMARIES),
    "ipynb_round_trip": (ipynb_round_trip, IPYNB),
    "reply_cache": (reply_cache, REPLY_CACHE),
}
