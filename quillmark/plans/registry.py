"""Every registered query of the engine with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.plans import notebooks, profiling, records, retrieval

#: name -> (query, SQL or None)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = profiling.QUERIES | retrieval.QUERIES | records.QUERIES | notebooks.QUERIES
