"""Keyed tables on Parquet: upserts, lookups, deletes, least-recently-used trims, and the embedding cache.

A table is a folder of parts, each in immutable files, and of numbered manifests that say which files are the table's, so
a change rewrites the parts that it touches and readers never see half of it.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import embedding_key
from quillmark.functions.vectors import Embedder, embed
from quillmark.sources.shared import checkpointed, running_sums

#: Parts of a new store.
PARTS = 16

MAX_ENTRIES, MAX_BYTES, LOW_WATERMARK, ENTRY_BYTES = 10_000, 20 << 20, 0.8, 300


def latest(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in order.  Rows are combined before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def removed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


class Conflict(Exception):
    """A change that other writers kept from being published."""


@dataclass(frozen=True)
class Manifest:
    """One state of a store: where each of its parts lies.  Parts without rows have no place."""

    number: int
    parts: int
    places: dict[int, str]


class Store:
    """A keyed table in a folder, cut into parts by the hash of the key.

    A change writes the parts that it touches into a new folder, and then a manifest, numbered one higher, that says where
    every part lies.  Other parts aren't read or written, and readers see the state before or after, never half of it.  A
    manifest's file is created only if it isn't there yet, so of two writers one comes first; the other goes on from there:
    if it touched other parts its own are still right and only its manifest is made anew, else the change is made again on
    the newer rows.  Files that none of the last `keep` states has are deleted, so a frame that was read stays good for that
    many changes.

    `parts` counts for a new store only; it should make parts of some hundred megabytes.  `cluster`: columns by which a
    part's rows are sorted, so that filters on them skip most of its files' row groups.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", parts: int = PARTS, cluster: Sequence[str] = (), keep: int = 8):
        self.spark, self.path, self.schema, self.key, self.parts, self.cluster, self.keep = spark, path.rstrip("/"), schema, key, parts, tuple(cluster), keep
        jvm = spark.sparkContext._jvm
        self._place = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._place("manifests").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = lambda place: jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(place), "UTF-8")

    def part_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.manifest().parts)).cast("int")

    def _numbers(self) -> list[int]:
        place = self._place("manifests")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _manifest(self, number: int) -> Manifest | None:
        try:
            told = json.loads(self._text(self._place(f"manifests/{number:012d}")))
        except ValueError:  # not complete yet
            return None
        return Manifest(number, told["parts"], {int(k): v for k, v in told["places"].items()})

    def manifest(self) -> Manifest:
        """The last state.  A manifest that stays incomplete is one of a writer that died: it changed nothing."""
        numbers = self._numbers()
        for number in reversed(numbers):
            for wait in (0.0, 0.2, 1.0, 4.0):
                time.sleep(wait)
                found = self._manifest(number)
                if found:
                    return Manifest(numbers[-1], found.parts, found.places)
        return Manifest(numbers[-1] if numbers else 0, self.parts, {})

    def _publish(self, state: Manifest) -> bool:
        """False if another writer has published a state of that number."""
        place = self._place(f"manifests/{state.number:012d}")
        try:
            out = self._fs.create(place, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps({"parts": state.parts, "places": state.places}).encode()))
        out.close()
        return True

    def _rows(self, state: Manifest, parts: Sequence[int] | None = None) -> DataFrame:
        places = [f"{self.path}/{state.places[k]}/_part={k}" for k in (sorted(state.places) if parts is None else parts) if k in state.places]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest())

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (a column of the key's name), from the parts that they can lie in."""
        keys = keys.select(self.key).distinct()
        parts = [r[0] for r in keys.select(self.part_of(F.col(self.key))).distinct().collect()]
        return self._rows(self.manifest(), parts).join(keys, self.key, "left_semi")

    def change(self, touched: Callable[[DataFrame], DataFrame | None], changed: Callable[[DataFrame], DataFrame], attempts: int = 20) -> DataFrame:
        """Replaces the rows of some parts by what changed() makes of them.

        touched() gets the stored rows and returns rows with the key whose parts change, or None for all parts.  Both
        are asked again if another writer changes one of these parts meanwhile.
        """
        for _ in range(attempts):
            state = self.manifest()
            asked = touched(self._rows(state))
            number = F.pmod(F.xxhash64(self.key), F.lit(state.parts)).cast("int")
            parts = list(range(state.parts)) if asked is None else sorted(r[0] for r in asked.select(number).distinct().collect())
            if not parts:
                return self._rows(state)
            version = uuid.uuid4().hex
            rows = changed(self._rows(state, parts)).withColumn("_part", number)
            rows.repartition(len(parts), "_part").sortWithinPartitions("_part", *self.cluster).write.partitionBy("_part").parquet(f"{self.path}/{version}")
            made = {k: version for k in parts if self._fs.exists(self._place(f"{version}/_part={k}"))}
            base = state
            while all(base.places.get(k) == state.places.get(k) for k in parts):
                new = Manifest(base.number + 1, state.parts, {k: v for k, v in base.places.items() if k not in parts} | made)
                if self._publish(new):
                    self._clean(new)
                    return self._rows(new)
                base = self.manifest()
            self._fs.delete(self._place(version), True)
        raise Conflict(f"other writers changed the same parts {attempts} times")

    def _clean(self, state: Manifest) -> None:
        """Deletes states older than the last ones, and the files that only those have."""
        old = [k for k in self._numbers() if k <= state.number - self.keep]
        if not old:
            return
        kept = [m for k in self._numbers() if k > state.number - self.keep and (m := self._manifest(k))]
        alive = {x for m in kept for x in m.places.items()}
        versions = {v for _, v in alive}
        for number in old:
            gone = self._manifest(number)
            for part, version in gone.places.items() if gone else ():
                if version not in versions:
                    self._fs.delete(self._place(version), True)
                elif (part, version) not in alive:
                    self._fs.delete(self._place(f"{version}/_part={part}"), True)
            self._fs.delete(self._place(f"manifests/{number:012d}"), False)

    def write(self, df: DataFrame) -> DataFrame:
        """df in place of all rows."""
        kept = checkpointed(df)
        return self.change(lambda _: None, lambda _: kept)

    def put(self, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
        """Stores rows in place of those with their keys; of several with one key the last in order, by default of all columns."""
        comparable = [f.name for f in rows.schema if f.name != self.key and not re.search("map<|variant", f.dataType.simpleString())]
        new = checkpointed(latest(rows, self.key, order or comparable))
        return self.change(lambda _: new, lambda old: upserted(old, new, self.key))

    def get(self, condition: Column) -> DataFrame:
        return self.read().filter(condition)

    def delete(self, condition: Column) -> DataFrame:
        """Rows for which the condition is null stay."""
        return self.change(lambda rows: rows.filter(condition), lambda rows: rows.filter(~F.coalesce(condition, F.lit(False))))

    def retain(self, rows: DataFrame) -> DataFrame:
        """Deletes what isn't among rows (of the key); parts that lose nothing stay."""
        kept = checkpointed(rows.select(self.key))
        return self.change(lambda old: old.join(kept, self.key, "left_anti"), lambda old: old.join(kept, self.key, "left_semi"))

    def clear(self) -> DataFrame:
        return self.change(lambda _: None, lambda rows: rows.limit(0))


NOTEBOOK_SCHEMA = "id string, workspace_id string, title string, cells string, created_at timestamp, updated_at timestamp"


class NotebookStore:
    """Notebooks by id; cells are kept as one JSON text, so nothing of a cell is lost."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path, NOTEBOOK_SCHEMA)

    def get(self, notebook_id: str) -> DataFrame:
        """The notebook, or no row."""
        return self.store.get(F.col("id") == notebook_id)

    def of_workspace(self, workspace_id: str) -> DataFrame:
        """The workspace's notebook, the first by id if there are several, or no row."""
        return self.store.get(F.col("workspace_id") == workspace_id).orderBy("id").limit(1)

    def listed(self, workspace_id: str) -> DataFrame:
        """The list of a workspace's notebooks: the one it has."""
        return self.of_workspace(workspace_id)

    def put(self, notebooks: DataFrame, now: Column) -> DataFrame:
        """Stores notebooks in place of those with their ids; of several with one id the last created one."""
        return self.store.put(notebooks.withColumn("updated_at", now.cast("timestamp")).select(*(x.split()[0] for x in NOTEBOOK_SCHEMA.split(", "))), ["created_at", "cells"])

    def delete(self, notebook_id: str) -> DataFrame:
        return self.store.delete(F.col("id") == notebook_id)

    def clear(self) -> DataFrame:
        return self.store.clear()


def trimmed_by_count(df: DataFrame, used: str, key: str, most: int = MAX_ENTRIES) -> DataFrame:
    """The `most` rows used last: a bounded top-k on each partition, then a merge."""
    return df.orderBy(F.desc(used), F.desc(key)).limit(most)


def entry_bytes(vector: Column, *texts: Column) -> Column:
    """Four bytes a component, two a character, and a fixed part."""
    return 4 * F.coalesce(F.size(vector), F.lit(0)) + 2 * sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(0)) + ENTRY_BYTES


def trimmed_by_bytes(df: DataFrame, size: Column, used: str, key: str, most_rows: int = MAX_ENTRIES, most_bytes: int = MAX_BYTES, low: float = LOW_WATERMARK, owner: str | None = None) -> DataFrame:
    """Within each owner: unchanged under both quotas, else the rows used last that fit both at the low watermark.

    Running numbers and bytes come from ranges of the order and what lies before each, so no task holds an owner's rows.
    """
    own = df.columns
    whose = F.coalesce(F.concat(F.lit("of "), F.col(owner).cast("string")), F.lit("")) if owner else F.lit("")
    sized = df.withColumns({"_owner": whose, "_size": size.cast("bigint"), "_one": F.lit(1)})
    running = running_sums(sized, "_owner", [F.desc(used), F.desc(key)], {"_rn": "_one", "_sum": "_size"})
    totals = running.groupBy("_owner").agg(F.max("_rn").alias("_rows"), F.max("_sum").alias("_all"))
    over = totals.filter((F.col("_rows") > most_rows) | (F.col("_all") > most_bytes)).select("_owner", F.lit(True).alias("_over"))
    fits = (F.col("_rn") <= int(most_rows * low)) & (F.col("_sum") <= int(most_bytes * low))
    return running.join(over, "_owner", "left").filter(F.col("_over").isNull() | fits).select(*own)


CACHE_SCHEMA = "key string, model string, vector array<float>, created_at timestamp, used_at timestamp"


def through_cache(cache: DataFrame, texts: DataFrame, model: str, embedder: Embedder, now: Column) -> tuple[DataFrame, DataFrame]:
    """(text, vector) of every text, and the cache with new entries and used ones touched.

    Only texts without an entry reach the model, each once.
    """
    keyed = texts.select("text").filter("text is not null").distinct().withColumn("key", embedding_key(F.lit(model), F.col("text")))
    hits = keyed.join(cache.select("key", "vector"), "key", "left")
    made = checkpointed(embed(hits.filter("vector is null"), "text", embedder).join(keyed, "text"))
    known = hits.filter("vector is not null").select("text", "vector").unionByName(made.select("text", "vector"))
    touched = cache.join(keyed.select("key").withColumn("_hit", F.lit(True)), "key", "left").withColumn("used_at", F.when(F.col("_hit"), now).otherwise(F.col("used_at"))).drop("_hit")
    fresh = made.select("key", F.lit(model).alias("model"), "vector", now.alias("created_at"), now.alias("used_at"))
    return known, touched.unionByName(fresh)
