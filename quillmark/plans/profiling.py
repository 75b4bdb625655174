"""Profiling queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import profile
from quillmark.operators.profile import DatasetSpec
from quillmark.plans.common import GAPS_SQL, missing_sql, orders_with_gaps, rounded_sql, table

ORDERS = DatasetSpec("orders.CSV", order=("o_orderkey",))


def profile_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of orders that repeat, with empty rows, an empty and a constant column."""
    key, kept = F.col("o_orderkey"), F.col("o_orderkey") % 1000 != 0
    df = table(spark, sf_dir, "orders").select(F.when(kept, F.floor(key / 3)).alias("group"), F.when(kept, F.col("o_orderstatus")).alias("status"), F.when(kept, "x").alias("constant"), F.lit(None).cast("string").alias("nothing"))
    out = profile.dataset_profile(df, DatasetSpec("orders.CSV", order=("group", "status")))
    return out.withColumn("constant_cols", F.array_join("constant_cols", ",")).withColumn("column_count_by_type", F.array_join(F.transform(F.array_sort(F.map_entries("column_count_by_type")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ","))


PROFILE_DATASET = f"""WITH d AS (SELECT CASE WHEN o_orderkey % 1000 <> 0 THEN o_orderkey // 3 END AS g, CASE WHEN o_orderkey % 1000 <> 0 THEN o_orderstatus END AS s FROM orders),
 head AS (SELECT g, s FROM d ORDER BY g NULLS FIRST, s NULLS FIRST LIMIT 5000), dup AS (SELECT CAST(sum(c) - count(*) AS BIGINT) AS repeated, sum(c) AS looked FROM (SELECT count(*) AS c FROM head GROUP BY g, s))
 SELECT 'orders.CSV' AS file_name, count(*) AS rows, CAST(4 AS INTEGER) AS cols, count(*) * 32 AS file_size_estimate, 'categorical:3,numeric:1' AS column_count_by_type, any_value(repeated) AS duplicate_rows,
 {rounded_sql("100.0 * any_value(repeated) / any_value(looked)", 2)} AS duplicate_pct, count(*) FILTER (WHERE g IS NULL AND s IS NULL) AS empty_rows, CAST(1 AS INTEGER) AS empty_cols, 'constant' AS constant_cols, 'csv' AS format FROM d, dup"""


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DatasetSpec("events.parquet", order=("event_id",))
    head = profile.first_rows(table(spark, sf_dir, "events"), spec).select(F.floor(F.col("user_id") / 10).alias("u"), "event_type")
    groups = head.groupBy("u", "event_type").count()
    return groups.agg(F.sum("count").alias("rows"), (F.sum("count") - F.count("*")).alias("duplicate_rows"))


DUPLICATE_ROWS = """WITH head AS (SELECT user_id // 10 AS u, event_type FROM events ORDER BY event_id LIMIT 5000), g AS (SELECT u, event_type, count(*) AS c FROM head GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c) - count(*) AS BIGINT) AS duplicate_rows FROM g"""

FOLDER = {"region": ("r_regionkey",), "nation": ("n_nationkey", "n_regionkey"), "customer": ("c_custkey", "c_nationkey", "c_acctbal"), "supplier": ("s_nationkey", "s_acctbal"), "part": ("p_size", "p_retailprice"), "orders": ("o_custkey", "o_totalprice"), "events": ("user_id", "value"), "lineitem": ("l_quantity", "l_tax")}
NUMERIC = {"lineitem": ("l_quantity", "l_extendedprice", "l_discount")}


def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric_profile(table(spark, sf_dir, "lineitem").select(*NUMERIC["lineitem"]), DatasetSpec("lineitem.parquet"))


def profile_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric columns of all tables of orders and their parties, in one state; one column has no number."""
    frames = {name: table(spark, sf_dir, name).select(*columns) for name, columns in FOLDER.items()}
    return profile.folder_profile(frames | {"region": frames["region"].withColumn("nothing", F.lit(float("nan")))})


def _numeric_sql(column: str, source: str = "lineitem", name: str | None = None) -> str:
    r = rounded_sql
    return f"""SELECT '{name or column}' AS "column", n, {r("mean", 3)} AS mean, {r("med", 3)} AS median, mode, mn AS min, mx AS max, {r("mx - mn", 3)} AS "range", {r("q1", 3)} AS q1, {r("q3", 3)} AS q3, {r("q3 - q1", 3)} AS iqr,
 {r("s * s", 3)} AS variance, {r("s", 3)} AS std, CASE WHEN n < 3 OR s = 0 THEN 0.0 ELSE {r("sk", 3)} END AS skewness, CASE WHEN n < 3 OR s = 0 THEN 0.0 ELSE {r("ku", 3)} END AS kurtosis
 FROM (SELECT count(*) AS n, any_value(m.mean) AS mean, median(x) AS med, min(x) AS mn, max(x) AS mx, any_value(m.s) AS s, sum(power((x - m.mean) / m.s, 3)) / count(*) AS sk, sum(power((x - m.mean) / m.s, 4)) / count(*) - 3 AS ku,
  max(CASE WHEN rn = m.n // 4 + 1 THEN x END) AS q1, max(CASE WHEN rn = (m.n * 3) // 4 + 1 THEN x END) AS q3, any_value(mo.x0) AS mode
  FROM (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) AS rn FROM {source}) v,
   (SELECT count({column}) AS n, avg({column}) AS mean, stddev_samp({column}) AS s FROM {source}) m,
   (SELECT {column} AS x0 FROM {source} GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1) mo)"""


PROFILE_FOLDER = " UNION ALL ".join(_numeric_sql(c, name, f"{name}.{c}") for name, columns in FOLDER.items() for c in columns) + " UNION ALL SELECT 'region.nothing', 0, " + ", ".join(["NULL"] * 13)
PROFILE_NUMERIC = " UNION ALL ".join(_numeric_sql(c) for c in NUMERIC["lineitem"])


def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_counts(orders_with_gaps(spark, sf_dir), ["priority", "status", "custkey"])


COLUMN_COUNTS = f"WITH {GAPS_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER (WHERE {missing_sql(c)}) AS missing, {rounded_sql(f"100.0 * count(*) FILTER (WHERE {missing_sql(c)}) / count(*)", 2)} AS missing_pct,
 count(DISTINCT {c}) FILTER (WHERE NOT {missing_sql(c)}) AS "unique", {rounded_sql(f"count(DISTINCT {c}) FILTER (WHERE NOT {missing_sql(c)}) / CAST(count(*) AS DOUBLE)", 3)} AS cardinality_ratio FROM gaps"""
    for c in ("priority", "status", "custkey")
)


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(orders_with_gaps(spark, sf_dir), ORDERS, ["priority", "status"])


TOP_VALUES = f"WITH {GAPS_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(rank AS INTEGER) AS rank, value, count, {rounded_sql("100.0 * count / total", 2)} AS pct FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS count, CAST(sum(count(*)) OVER () AS BIGINT) AS total,
 row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey)) AS rank FROM gaps WHERE NOT {missing_sql(c)} GROUP BY {c}) WHERE rank <= 5"""
    for c in ("priority", "status")
)


def profile_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.categorical_profile(orders_with_gaps(spark, sf_dir), ORDERS, ["priority", "status"])


PROFILE_CATEGORICAL = f"WITH {GAPS_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {rounded_sql("-sum(p * log2(p))", 2)} AS entropy, arg_max(value, (count, -first)) AS mode FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS count, min(o_orderkey) AS first, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM gaps WHERE NOT {missing_sql(c)} GROUP BY {c})"""
    for c in ("priority", "status")
)


def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_profile(orders_with_gaps(spark, sf_dir))


GAP_COLUMNS = ("o_orderkey", "priority", "status", "custkey", "totalprice")
MISSING_PROFILE = f"WITH {GAPS_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", m AS missing, {rounded_sql("100.0 * m / n", 2)} AS missing_pct, 100.0 * m / n > 20 AS high FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {missing_sql(c)}) AS m FROM gaps)"""
    for c in GAP_COLUMNS
)


def missing_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_per_row(orders_with_gaps(spark, sf_dir))


_PER_ROW = " + ".join(f"CAST({missing_sql(c)} AS INTEGER)" for c in GAP_COLUMNS)
MISSING_PER_ROW = f"WITH {GAPS_SQL} SELECT {rounded_sql(f'avg({_PER_ROW})', 2)} AS avg_missing_per_row, CAST(max({_PER_ROW}) AS INTEGER) AS max_missing_per_row FROM gaps"


def missing_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missing_together(orders_with_gaps(spark, sf_dir))


_FOUR = GAP_COLUMNS[1:]
MISSING_TOGETHER = f"WITH {GAPS_SQL}, p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {missing_sql(a)} AND {missing_sql(b)}) / sqrt(CAST(count(*) FILTER (WHERE {missing_sql(a)}) AS DOUBLE) * count(*) FILTER (WHERE {missing_sql(b)})) AS raw FROM gaps"
    for i, a in enumerate(_FOUR) for b in _FOUR[i + 1 :]
) + f") SELECT a, b, {rounded_sql('raw', 2)} AS coefficient FROM p WHERE raw > 0.3"


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.key_profile(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ORDERS)


DUPLICATE_KEYS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) > 0.98 AS unique_col, count(DISTINCT {c}) = count(*) AS candidate_key, count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) > 0.5 AS high_cardinality FROM orders"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
)


def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    pairs = profile.composite_keys(df, DatasetSpec("customer.parquet", order=("c_custkey",)))
    return spark.createDataFrame([(k + 1, a, b) for k, (a, b) in enumerate(pairs)], "place int, a string, b string")


#: Name and key are unique, and the balance of nearly all; after two pairs, each first column adds at most one.
COMPOSITE_KEYS = """WITH head AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 5000), u AS (SELECT count(*) AS n, count(DISTINCT (c_custkey, c_name)) AS p1, count(DISTINCT (c_custkey, c_acctbal)) AS p2, count(DISTINCT (c_name, c_acctbal)) AS p3 FROM head)
 SELECT 1 AS place, 'c_custkey' AS a, 'c_name' AS b FROM u WHERE p1 = n UNION ALL SELECT 2, 'c_custkey', 'c_acctbal' FROM u WHERE p2 = n UNION ALL SELECT 3, 'c_name', 'c_acctbal' FROM u WHERE p3 = n"""


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    df = table(spark, sf_dir, "events").select(
        F.when(key % 9 == 0, F.concat(F.lit(" "), "event_type")).otherwise(F.col("event_type")).alias("type"),
        F.when(key % 13 == 0, "2024-01-02").when(key % 4 == 0, key.cast("string")).otherwise(F.col("event_type")).alias("mixed"),
        F.when(key % 10 == 0, "abc").when(key % 17 == 0, "n/a").otherwise((key % 100).cast("string")).alias("amount"),
    )
    return profile.quality_profile(df, DatasetSpec("events.parquet", {"amount": "numeric"}))


QUALITY_PROFILE = r"""WITH e AS (SELECT CASE WHEN event_id % 9 = 0 THEN ' ' || event_type ELSE event_type END AS type,
 CASE WHEN event_id % 13 = 0 THEN '2024-01-02' WHEN event_id % 4 = 0 THEN CAST(event_id AS VARCHAR) ELSE event_type END AS mixed,
 CASE WHEN event_id % 10 = 0 THEN 'abc' WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(event_id % 100 AS VARCHAR) END AS amount FROM events),
 v AS (SELECT 'type' AS "column", false AS numeric, type AS raw FROM e UNION ALL SELECT 'mixed', false, mixed FROM e UNION ALL SELECT 'amount', true, amount FROM e),
 k AS (SELECT "column", numeric, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM v),
 c AS (SELECT *, CASE WHEN lower(t) IN ('', '-', 'n/a', 'null', 'none', 'unknown', 'not available') THEN NULL WHEN regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'numeric' WHEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' ELSE 'string' END AS kind FROM k)
 SELECT "column", bool_or(raw <> t) AS whitespace, count(DISTINCT kind) > 1 AS mixed_types, count(*) FILTER (WHERE numeric AND kind <> 'numeric') AS invalid FROM c GROUP BY "column" """

QUERIES = {
    "profile_dataset": (profile_dataset, PROFILE_DATASET),
    "duplicate_rows": (duplicate_rows, DUPLICATE_ROWS),
    "profile_numeric": (profile_numeric, PROFILE_NUMERIC),
    "profile_folder": (profile_folder, PROFILE_FOLDER),
    "column_counts": (column_counts, COLUMN_COUNTS),
    "top_values": (top_values, TOP_VALUES),
    "profile_categorical": (profile_categorical, PROFILE_CATEGORICAL),
    "missing_profile": (missing_profile, MISSING_PROFILE),
    "missing_per_row": (missing_per_row, MISSING_PER_ROW),
    "missing_together": (missing_together, MISSING_TOGETHER),
    "duplicate_keys": (duplicate_keys, DUPLICATE_KEYS),
    "composite_keys": (composite_keys, COMPOSITE_KEYS),
    "quality_profile": (quality_profile, QUALITY_PROFILE),
}
