"""Streaming forms of the stateful parts: keyed upserts, the latest run, and time-limited deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillmark.sources.stores import Store


def upserts(stream: DataFrame, store: Store, order: list[str], checkpoint: str) -> DataStreamWriter:
    """Merges each micro-batch into a store.  A repeated batch writes the same rows again, so the merge is idempotent."""

    def merge(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            store.put(batch, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def latest_runs(stream: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """upload_id, pipeline, run, result: the last run so far; state goes once the watermark passes its window."""
    by = stream.withWatermark(time, delay).groupBy("upload_id", "pipeline", F.window(time, delay))
    return by.agg(F.max_by(F.struct("run", "result"), "run").alias("last")).select("upload_id", "pipeline", "last.*")


def first_replies(stream: DataFrame, time: str, ttl: str = "5 minutes") -> DataFrame:
    """The first reply of each key within the cache's time to live; repeats inside it are hits and drop out."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark(["key"])
