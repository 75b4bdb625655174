"""Chat context: history windows, folded histories, context lines, and the reply cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.text import cache_key
from quillmark.functions.vectors import cosine_or_zero

HISTORY_LIMIT, HEAD_KEEP, EVIDENCE, EVIDENCE_CHARS = 20, 1, 4, 400
TTL_SECONDS, CACHE_SIZE, SIMILAR = 300, 100, 0.95
HEADER_COLUMNS, NONE = 12, "—"


def history_window(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", limit: int = HISTORY_LIMIT, head: int = HEAD_KEEP) -> DataFrame:
    """The first `head` and the last messages of each conversation, `limit` in all; all with a limit below zero."""
    if limit < 0:
        return messages
    if limit == 0:
        return messages.limit(0)
    rn = F.row_number().over(Window.partitionBy(conversation).orderBy(turn))
    numbered = messages.withColumn("_rn", rn).withColumn("_n", F.count("*").over(Window.partitionBy(conversation)))
    head = min(head, limit)
    keep = (F.col("_n") <= limit) | (F.col("_rn") <= head) | (F.col("_rn") > F.col("_n") - (limit - head))
    return numbered.filter(keep).drop("_rn", "_n")


def folded(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """conversation, history: `User:` and `Assistant:` turns with text, a blank line between."""
    who = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    said = messages.filter(F.trim("text") != "").select(conversation, F.struct(turn, F.concat(who, "text").alias("line")).alias("s"))
    return said.groupBy(conversation).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n\n").alias("history"))


def context_line() -> Column:
    """`[kind] text (cell:… ws:… dataset:…)` of a record, with its sample, chunk and columns; a capability's reference and place."""
    p, extra, none = F.col("provenance"), F.col("metadata.extra"), F.lit(NONE)
    listed = lambda values, by: F.when(F.size(values) > 0, F.array_join(values, by))
    more = lambda name, c: F.coalesce(F.concat(F.lit(f" {name}="), c), F.lit(""))
    where = F.concat(
        F.lit("cell:"), F.coalesce(p["cell_id"], "cell_id", none), F.lit(" ws:"), F.coalesce(p["workspace_id"], "workspace_id", none),
        F.lit(" dataset:"), F.coalesce(listed(p["dataset_ids"], ", "), "dataset_id", none), more("coverage", p["sample_coverage"]), more("chunk", p["chunk_id"]), more("columns", listed(p["columns"], ",")),
    )
    unproved = F.when(extra["verified"] == "false", " experimental-verification-pending").otherwise("")
    place = F.concat(F.lit("ref: functionality:"), F.coalesce(extra["functionality_id"], "id"), F.lit(" ui:"), F.coalesce(extra["ui_path"], none), unproved)
    return F.concat(F.lit("["), "kind", F.lit("] "), "text", F.lit(" ("), F.when(F.col("kind").isin("functionality", "guide"), place).otherwise(where), F.lit(")"))


def evidence(built: DataFrame, hits: DataFrame, most: int = EVIDENCE, chars: int = EVIDENCE_CHARS) -> DataFrame:
    """id, text: records of the context that the search didn't find, the first few, shortened."""
    return built.join(hits.select("id"), "id", "left_anti").orderBy("_pos", "id").limit(most).select("id", F.substring("text", 1, chars).alias("text"))


def assembled(header: str, lines: DataFrame, histories: DataFrame | None = None) -> DataFrame:
    """prompt: a header and the context lines (query_id, place, line) of each query."""
    out = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n").alias("context"))
    if histories is not None:
        out = out.join(histories, "query_id", "left")
        return out.select("query_id", F.concat_ws("\n\n", F.lit(header), "context", "history").alias("prompt"))
    return out.select("query_id", F.concat_ws("\n\n", F.lit(header), "context").alias("prompt"))


def expert_header(file_name: str, rows: int, columns: Sequence[tuple[str, str]], cleaned: bool = False, summary: str | None = None, upload_id: str | None = None) -> str:
    """The line that grounds answers in a dataset: its size and its first columns (name, type)."""
    named = ", ".join(f"{name}({kind})" for name, kind in columns[:HEADER_COLUMNS])
    more = f" +{len(columns) - HEADER_COLUMNS} more" if len(columns) > HEADER_COLUMNS else ""
    return f'[dataset_expert] Expert of dataset "{file_name}" {NONE} {rows} rows × {len(columns)} cols{" (cleaned)" if cleaned else ""}{f" {NONE} {summary}" if summary else ""} {NONE} uploadId:{upload_id or "guest"} {NONE} columns: {named}{more}'


def datasets_header(dataset_ids: Sequence[str]) -> str:
    """The line in place of expert_header() where only ids are known."""
    return f"[dataset_expert] Current datasetIds: {', '.join(dataset_ids)}"


def prompts(asked: DataFrame, hits: DataFrame, built: DataFrame, notebooks: DataFrame, header: str = "", most: int = EVIDENCE, chars: int = EVIDENCE_CHARS) -> DataFrame:
    """query_id, prompt of every asked query: header, notebook context, hits, and evidence that the hits don't have.

    hits, built: query_id, place, and a record's columns; built are the records of a context (one record for an id), of
    which the first `most` that aren't hits are shown, shortened.  notebooks: query_id, notebook_context.  Hits and evidence are bounded by
    a search's limit.  Parts without text are left out.
    """
    joined = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n\n").alias(name)
    found = hits.select("query_id", "place", context_line().alias("line")).groupBy("query_id").agg(joined("hits"))
    fresh = built.join(hits.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    first = fresh.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "id"))).filter(F.col("_rn") <= most)
    shown = first.select("query_id", "place", F.concat(F.lit("["), "kind", F.lit("] "), F.substring("text", 1, chars)).alias("line")).groupBy("query_id").agg(joined("evidence"))
    all_ = asked.select("query_id").join(notebooks, "query_id", "left").join(found, "query_id", "left").join(shown, "query_id", "left")
    parts = (F.lit(header or None), F.concat(F.lit("[notebook_context]\n"), "notebook_context"), F.col("hits"), F.concat(F.lit("[notebook_evidence]\n"), "evidence"))
    return all_.select("query_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def live(cache: DataFrame, now: Column, ttl: int = TTL_SECONDS, most: int = CACHE_SIZE) -> DataFrame:
    """Entries (workspace, model, query, reply, at, vector) within their time, the last `most` put first of each key.

    A key that is set again within its time keeps its place in the order, and its newest reply counts; one that is set
    after its time is a new entry with a new place.  The bound on the number makes the ordered limit a small one.
    """
    keyed = cache.withColumn("key", cache_key(F.col("workspace"), F.col("model"), F.col("query")))
    before = Window.partitionBy("key").orderBy("at")
    renewed = F.coalesce(F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(before)) > ttl, F.lit(True))
    starts = keyed.withColumn("start", F.max(F.when(renewed, F.col("at"))).over(before))
    latest = starts.groupBy("key").agg(F.max("start").alias("first_at"), F.max_by(F.struct("workspace", "model", "query", "reply", "at", "vector"), "at").alias("e"))
    kept = latest.orderBy(F.desc("first_at"), "key").limit(most)
    return kept.select("key", "first_at", "e.*").filter(F.unix_timestamp(now) - F.unix_timestamp("at") <= ttl)


def exact_hits(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, reply of queries (query_id, workspace, model, query) with a live entry of the same key."""
    keyed = asked.withColumn("key", cache_key(F.col("workspace"), F.col("model"), F.col("query")))
    return keyed.join(entries.select("key", "reply"), "key").select("query_id", "reply")


def similar_hits(asked: DataFrame, entries: DataFrame, least: float = SIMILAR) -> DataFrame:
    """query_id, reply, similarity: the nearest live entry of the same workspace and model, ties to the later one."""
    e = entries.select("workspace", "model", "reply", "at", F.col("vector").alias("known"))
    e = F.broadcast(e) if entries.count() <= CACHE_SIZE else e
    near = asked.join(e, ["workspace", "model"]).withColumn("similarity", cosine_or_zero(F.col("vector"), F.col("known"))).filter(F.col("similarity") >= least)
    return near.groupBy("query_id").agg(F.max_by(F.struct("reply", "similarity"), F.struct("similarity", "at", "reply")).alias("best")).select("query_id", "best.*")
