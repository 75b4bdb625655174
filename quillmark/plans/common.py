"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.shared import read

#: A literal query of words that the documents have.
QUERY = "the and of that"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name)


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with missing values injected by key."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(key % 7 == 0, None).when(key % 11 == 0, "N/A").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(key % 7 == 0, " - ").when(key % 5 == 0, None).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(key % 3 == 0, None).otherwise(F.col("o_custkey")).alias("custkey"),
        F.when(key % 21 == 0, None).otherwise(F.col("o_totalprice")).alias("totalprice"),
    )


GAPS_SQL = """gaps AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 7 = 0 THEN ' - ' WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS custkey,
  CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE o_totalprice END AS totalprice
  FROM orders)"""


def missing_sql(column: str) -> str:
    text = f"lower(regexp_replace(CAST({column} AS VARCHAR), '^\\s+|\\s+$', '', 'g'))"
    return f"coalesce({text} IN ('', '-', 'n/a', 'null', 'none', 'unknown', 'not available'), true)"


def rounded_sql(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits}.0 + 0.5) / {10**digits}.0"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9+#-]+'), lambda t: length(t) > 1)"


def rounded(name: str, digits: int = 6):
    from quillmark.functions.coerce import js_round

    return js_round(F.col(name), digits).alias(name)
