"""The reply cache as a stateful stream: replies are put and asked for in the order of their times.

State is kept by workspace and model, at most `most` entries each.  A key that is set again within its time keeps its
place in the order of eviction and gets the newer reply; one that is set after its time is a new entry with a new place; what was put
first goes first.  Once the watermark has passed the time of all of a state's entries, it is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmark.functions.text import cache_key
from quillmark.operators.prompt import CACHE_SIZE, SIMILAR, TTL_SECONDS

FOUND = "query_id string, reply string, how string"


def similarity(a: list[float] | None, b: list[float] | None) -> float:
    """cosine_or_zero() for two vectors."""
    n = min(len(a), len(b)) if a is not None and b is not None else 0
    x, y = np.asarray(a if n else [], float)[:n], np.asarray(b if n else [], float)[:n]
    length = float(np.linalg.norm(x) * np.linalg.norm(y))
    return float(x @ y) / length if length else 0.0


class ReplyCache(StatefulProcessor):
    """Rows (query_id, key, reply, at in milliseconds, vector): with a reply they are put, without one they ask."""

    def __init__(self, ttl: int, most: int, least: float):
        self.ttl, self.most, self.least = 1000 * ttl, most, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "slot bigint, at bigint, reply string, vector array<double>")
        self.newest = handle.getValueState("newest", "at bigint")

    def put(self, held: dict, row) -> None:
        old = held.get(row.key)
        again = old is not None and row.at - old[1] <= self.ttl
        held[row.key] = (old[0] if again else row.at, max(row.at, old[1]) if again else row.at, row.reply, row.vector)
        if len(held) > self.most:
            del held[min(held, key=lambda k: (held[k][0], k))]

    def ask(self, held: dict, row) -> tuple[str, str] | None:
        live = {k: e for k, e in held.items() if 0 <= row.at - e[1] <= self.ttl}
        if row.key in live:
            return live[row.key][2], "exact"
        near = [(round(s, 12), e[1], e[2]) for e in live.values() if (s := similarity(row.vector, e[3])) >= self.least]
        return (max(near)[2], "similar") if near else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "query_id"], kind="stable")
        before = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        held, found = dict(before), []
        for row in batch.itertuples(index=False):
            if row.reply is not None:
                self.put(held, row)
            elif (hit := self.ask(held, row)) is not None:
                found.append((row.query_id, *hit))
        for k in before.keys() - held.keys():
            self.entries.removeKey((k,))
        for k, (slot, at, reply, vector) in held.items():
            if before.get(k) is not held[k]:
                self.entries.updateValue((k,), (int(slot), int(at), reply, None if vector is None else [float(x) for x in vector]))
        if held:
            newest = max(e[1] for e in held.values())
            was = self.newest.get()
            if was is None or was[0] != newest:
                if was is not None:
                    self.handle.deleteTimer(int(was[0]) + self.ttl + 1)
                self.newest.update((int(newest),))
                self.handle.registerTimer(int(newest) + self.ttl + 1)
        yield pd.DataFrame(found, columns=["query_id", "reply", "how"], dtype="object")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        self.newest.clear()
        yield pd.DataFrame([], columns=["query_id", "reply", "how"], dtype="object")

    def close(self) -> None:
        pass


def cached_replies(stream: DataFrame, delay: str = "0 seconds", ttl: int = TTL_SECONDS, most: int = CACHE_SIZE, least: float = SIMILAR) -> DataFrame:
    """query_id, reply, how (exact or similar) of a stream (query_id, workspace, model, query, reply, at, vector).

    Rows with a reply are put into the cache, those without ask.  The session's state store must be the RocksDB one.
    """
    rows = stream.withWatermark("at", delay).select("workspace", "model", F.col("query_id").cast("string").alias("query_id"), cache_key(F.col("workspace"), F.col("model"), F.col("query")).alias("key"), "reply", F.unix_millis("at").alias("at"), F.col("vector").cast("array<double>").alias("vector"), F.col("at").alias("event"))
    return rows.groupBy("workspace", "model").transformWithStateInPandas(ReplyCache(ttl, most, least), FOUND, "Append", "EventTime")
