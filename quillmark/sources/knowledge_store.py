"""Stores of records, vectors and embeddings, with the lookups that callers use."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import embedding_key
from quillmark.operators.knowledge import RECORD, normalized
from quillmark.operators.search import of_column, of_datasets, vector_search
from quillmark.sources.stores import CACHE_SCHEMA, MAX_BYTES, Store, entry_bytes, trimmed_by_count


class KnowledgeStore:
    """Records by id.  They are normalised when written and when read."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path, RECORD, cluster=("workspace_id", "notebook_id"))

    def put(self, records: DataFrame) -> DataFrame:
        return self.store.put(normalized(records), ["updated_at", "source_hash"])

    def all(self) -> DataFrame:
        return normalized(self.store.read())

    def where(self, condition: Column) -> DataFrame:
        return normalized(self.store.get(condition))

    def by_workspace(self, workspace: str) -> DataFrame:
        return self.where(F.col("workspace_id") == workspace)

    def by_notebook(self, notebook: str) -> DataFrame:
        return self.where(F.col("notebook_id") == notebook)

    def by_cell(self, cell: str) -> DataFrame:
        return self.where(F.col("cell_id") == cell)

    def by_source_hash(self, value: str) -> DataFrame:
        return self.where(F.col("source_hash") == value)

    def by_dataset(self, dataset: str) -> DataFrame:
        return self.all().filter(of_datasets([dataset]))

    def by_column(self, name: str) -> DataFrame:
        return self.all().filter(of_column(name))

    def remove(self, *ids: str) -> DataFrame:
        return self.store.delete(F.col("id").isin(*ids))

    def remove_cell(self, cell: str) -> DataFrame:
        return self.store.delete(F.col("cell_id") == cell)

    def clear_workspace(self, workspace: str) -> DataFrame:
        return self.store.delete(F.col("workspace_id") == workspace)

    def clear(self) -> DataFrame:
        return self.store.clear()


class VectorStore:
    """Vectors by key `uid:vector:content:id`, sorted by owner within parts."""

    SCHEMA = "key string, content_hash string, id string, workspace_id string, kind string, text string, embedding array<float>, used_at timestamp, uid string"

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path, self.SCHEMA, key="key", cluster=("uid", "content_hash"))

    def upsert(self, rows: DataFrame) -> DataFrame:
        key = F.concat_ws(":", "uid", F.lit("vector"), "content_hash", "id")
        return self.store.put(rows.withColumn("key", key).select(*(x.strip().split(" ")[0] for x in self.SCHEMA.split(","))), ["used_at"])

    def all(self, uid: str, workspace: str | None = None) -> DataFrame:
        own = self.store.get(F.col("uid") == uid)
        return own if workspace is None else own.filter(F.col("workspace_id") == workspace)

    def get(self, uid: str, content_hash: str, record_id: str) -> DataFrame:
        """The vector of one key, or no row."""
        spark = self.store.spark
        return self.store.of_keys(spark.createDataFrame([(":".join((uid, "vector", content_hash, record_id)),)], "key string"))

    def delete_content(self, uid: str, content_hash: str) -> DataFrame:
        return self.store.delete((F.col("uid") == uid) & (F.col("content_hash") == content_hash))

    def clear(self) -> DataFrame:
        return self.store.clear()

    def search(self, uid: str, query: list[float], k: int = 8, workspace: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
        return vector_search(self.all(uid, workspace), query, k, F.col("kind").isin(*kinds) if kinds else None, key="key")


class EmbeddingCache:
    """Embeddings by model and text."""

    def __init__(self, spark: SparkSession, path: str, most: int = 10_000):
        self.store, self.most = Store(spark, path, CACHE_SCHEMA, key="key"), most

    def get(self, model: str, texts: DataFrame) -> DataFrame:
        keyed = texts.select("text").distinct().withColumn("key", embedding_key(F.lit(model), F.col("text")))
        return keyed.join(self.store.of_keys(keyed).select("key", "vector"), "key").select("text", "vector")

    def has(self, model: str, text: str) -> bool:
        spark = self.store.spark
        return self.get(model, spark.createDataFrame([(text,)], "text string")).limit(1).count() == 1

    def set(self, model: str, vectors: DataFrame) -> DataFrame:
        """vectors: text, vector.  Beyond a quota, of entries or of bytes, the cache is trimmed."""
        now = F.current_timestamp()
        rows = vectors.select(embedding_key(F.lit(model), F.col("text")).alias("key"), F.lit(model).alias("model"), "vector", now.alias("created_at"), now.alias("used_at"))
        self.store.put(rows, ["used_at"])
        return self.trim() if self.full() else self.store.read()

    def touch(self, model: str, texts: DataFrame) -> DataFrame:
        keys = texts.select(embedding_key(F.lit(model), F.col("text")).alias("key"))
        return self.store.put(self.store.of_keys(keys).withColumn("used_at", F.current_timestamp()), ["used_at"])

    def invalidate(self, model: str) -> DataFrame:
        return self.store.delete(F.col("model") == model)

    def full(self) -> bool:
        """Over the quota of entries or that of bytes."""
        n, size = self.store.read().agg(F.count("*"), F.coalesce(F.sum(entry_bytes(F.col("vector"))), F.lit(0))).first()
        return n > self.most or size > MAX_BYTES

    def trim(self) -> DataFrame:
        """The entries used last, up to their number; bytes alone take none away."""
        return self.store.retain(trimmed_by_count(self.store.read(), "used_at", "key", self.most))

    def clear(self) -> DataFrame:
        return self.store.clear()

    def count(self) -> int:
        return self.store.read().count()


class TtlMemo:
    """Driver-side values by key that expire when they are read too late."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.time):
        self.seconds, self.clock, self._held = seconds, clock, {}

    def get(self, uid: str, space: str, key: str):
        found = self._held.get((uid, space, key))
        if found is None or self.clock() - found[0] > self.seconds:
            self._held.pop((uid, space, key), None)
            return None
        return found[1]

    def put(self, uid: str, space: str, key: str, value) -> None:
        self._held[uid, space, key] = (self.clock(), value)
