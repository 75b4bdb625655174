"""What the text operators share: bounded Arrow batches, document hold-out, and tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
import zlib
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.shared import read, shared_folder

#: Text bytes that a Python worker holds at once; a longer single text forms a block of its own.
BLOCK_BYTES = 2 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker, which both hold; by rows alone, long texts make large ones.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, as bigint and string; a null text counts as empty.

    Selecting first keeps every other column, whatever its name, out of the operator and out of the scan.
    """
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes for this session, unless it already asks for smaller ones."""
    found = re.fullmatch(r"(\d+)b?", str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
    if not found or int(found[1]) <= 0 or int(found[1]) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that column number `text` of each piece has at most `limit` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        size = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Gives freed memory back to the system, as an idle Python worker would hold it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out of every training step."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table into the shared folder and reads it back: cuts lineage, survives a lost executor.

    The table lasts as long as the application: what is returned may be lazy and read it later.
    """
    return stored(df, what)[0]


def stored(df: DataFrame, what: str) -> tuple[DataFrame, Callable[[], None]]:
    """written(), and what deletes the table before the application ends, once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quillmark-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), lambda: files.delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def counted(df: DataFrame, what: str, **more: Column) -> tuple[DataFrame, dict[str, int]]:
    """written(), with the number of rows as n and other aggregates, observed while writing."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in more.items())), what)
    return out, seen.get


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_state: dict[Hashable, object] = {}


def worker_state(key: Hashable, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: the state of one operator, the last that it served.

    A worker is reused by whatever runs next, so the state of another operator would stay for its life.  What is made is
    taken out of cyclic collection, which would walk it again and again.
    """
    if key not in _state:
        _state.clear()
        gc.unfreeze()
        gc.collect()
        _state[key] = make()
        gc.freeze()
    return _state[key]
