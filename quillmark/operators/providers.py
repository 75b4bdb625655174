"""Record providers: whole datasets, their relations, and fixed catalogues, as functions that return records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.text import tokens_of
from quillmark.operators import knowledge, lexical, profile, sampling
from quillmark.operators.profile import DatasetSpec

#: A provider makes records for a workspace.
Provider = Callable[[SparkSession, str], DataFrame]
CHUNK_TOKENS, TOKEN_OVERLAP = 512, 50


def token_chunks(df: DataFrame, key: str, text: str, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], most: int = CHUNK_TOKENS, overlap: int = TOKEN_OVERLAP) -> DataFrame:
    """key, chunk, text: windows of `most` tokens of a pluggable tokenizer, each starting `most - overlap` later."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, value in zip(batch[key], batch[text], strict=True):
                ids = encode(value or "")
                start, n = 0, 0
                while n == 0 or start < len(ids):
                    rows.append((k, n, decode(ids[start : start + most])))
                    n += 1
                    if start + most >= len(ids):
                        break
                    start += most - overlap
            yield pd.DataFrame(rows, columns=["key", "chunk", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"key {kind}, chunk int, text string").withColumnRenamed("key", key)


def rows_of_chunks(chunks: int, positions: list[int]) -> list[list[int]]:
    """The sampled rows that each chunk stands for, in equal slices."""
    per = -(-len(positions) // max(1, chunks))
    return [positions[k * per : (k + 1) * per] for k in range(chunks)]


def column_texts(df: DataFrame, spec: DatasetSpec, rich: int = knowledge.RICH_COLUMNS) -> list[tuple[str, str]]:
    """(column, sentence): the first columns with their statistics, the others by name and type."""
    first = df.columns[:rich]
    kinds = {c: spec.kind(df, c) for c in df.columns}
    counts = profile.column_counts(df, first)
    texts = {c: f'Column "{c}" is {k}' for c, k in kinds.items()}
    numeric = [c for c in first if kinds[c] == "numeric"]
    other = [c for c in first if kinds[c] != "numeric"]
    if numeric:
        stats = profile.numeric_profile(df, spec, numeric).join(counts, "column").withColumn("kind", F.lit("numeric")).filter("n > 0")
        texts |= {r["column"]: r["text"] for r in stats.select("column", knowledge.rich_text(True).alias("text")).collect()}
    if other:
        top = profile.top_values(df, spec, other).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "pct"))).alias("top"))
        names = F.create_map(*(F.lit(x) for c in other for x in (c, kinds[c])))
        stats = counts.join(top, "column").join(profile.categorical_profile(df, spec, other), "column").withColumn("kind", names[F.col("column")])
        texts |= {r["column"]: r["text"] for r in stats.select("column", knowledge.rich_text(False).alias("text")).collect()}
    return [(c, texts[c]) for c in df.columns]


def representative_texts(df: DataFrame, spec: DatasetSpec, dataset_id: str, content_hash: str, chunk_chars: int = T.CHUNK_CHARS) -> list[tuple[str, list[int]]]:
    """(chunk, row positions): sampled rows as text, joined by lines and cut into windows."""
    n = df.count()
    if not n:
        return []
    mode, size = sampling.selection(n)
    placed = sampling.with_position(df, list(spec.order or df.columns))
    numeric = next((c for c in df.columns if spec.kind(df, c) == "numeric"), None)
    categorical = next((c for c in df.columns if spec.kind(df, c) == "categorical"), None)
    positions = sampling.sample_positions(placed, "_pos", n, n if mode == "exact" else size, sampling.seed_of(dataset_id, content_hash), numeric, categorical)
    rows = sampling.rows_at(placed, "_pos", positions).select("place", T.row_text(df.columns).alias("t")).orderBy("place").collect()
    joined = df.sparkSession.createDataFrame([("\n".join(r["t"] for r in rows),)], "t string")
    pieces = joined.select(T.chunks(F.col("t"), chunk_chars).alias("c")).first()["c"]
    return list(zip(pieces, rows_of_chunks(len(pieces), positions), strict=True))


def dataset_provider(df: DataFrame | None, spec: DatasetSpec, dataset_id: str, objective: str | None = None, profiled: bool = True, content_hash: str = "") -> Provider:
    """Description, profile, columns and sampled rows of a dataset; header-only columns before it is profiled."""

    def provide(spark: SparkSession, workspace: str) -> DataFrame:
        if df is None:
            return knowledge.empty_records(spark)
        kinds = {c: spec.kind(df, c) for c in df.columns}
        summary = profile.dataset_profile(df, spec).first().asDict()
        texts = [("description", "dataset_profile", knowledge.dataset_description(df, spec.file_name, kinds, summary["rows"], objective), None)]
        texts.append(("profile", "dataset_profile", knowledge.dataset_profile_text(summary), None))
        columns = column_texts(df, spec) if profiled else [(c, f'Column "{c}" is {k}') for c, k in kinds.items()]
        texts += [(f"col:{c}", "column_semantic", t, c) for c, t in columns]
        chunks = representative_texts(df, spec, dataset_id, content_hash) or [(knowledge.fallback_text(spec.file_name, dataset_id, [(c, k, None) for c, k in kinds.items()]), [])]
        texts += [(f"rep:{k}", "data_representative", t, None, rows) for k, (t, rows) in enumerate(chunks)]
        return knowledge.dataset_records(spark, workspace, dataset_id, texts, spec.file_name, content_hash)

    return provide


def relationship_provider(df: DataFrame, spec: DatasetSpec, dataset_id: str) -> Provider:
    """Columns missing together, keys, invalid values and high missing rates of a profiled dataset."""

    def provide(spark: SparkSession, workspace: str) -> DataFrame:
        repeated, looked = profile.duplicate_rows(df, spec)
        keys = {r["column"] for r in profile.key_profile(df, spec).filter("candidate_key").collect()}
        missing = profile.missing_profile(df).filter("high").collect()
        high = [c for c in df.columns if c in {r["column"] for r in missing}]
        texts = knowledge.relationship_texts(dataset_id, profile.missing_together(df), [c for c in df.columns if c in keys][: profile.CANDIDATES], (repeated, round(100.0 * repeated / max(1, looked), 2)), profile.composite_keys(df, spec), profile.quality_profile(df, spec), high, profile.missing_per_row(df).first()[0] or 0.0)
        if not texts:
            return knowledge.empty_records(spark)
        rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "pos int, id string, text string")
        return knowledge.records(rows, id=F.col("id"), kind="relationship", text=F.col("text"), workspace=F.lit(workspace), notebook=F.lit(f"nb:{workspace}"), dataset=F.lit(dataset_id), metadata={"source": F.lit("relationship")}, provenance={"dataset_ids": F.array(F.lit(dataset_id)), "upload_id": F.lit(dataset_id)}, hash_of=F.concat_ws(":", F.lit(workspace), F.col("id")), pos=F.col("pos"))

    return provide


def plain_records(df: DataFrame, spec: DatasetSpec, dataset_id: str, top: int = 5) -> Provider:
    """The short forms of profile, column and relation records that another client of the same store writes."""

    def provide(spark: SparkSession, workspace: str) -> DataFrame:
        s = profile.dataset_profile(df, spec).first()
        texts = [("profile", "dataset_profile", f"Dataset {spec.file_name} profile: {s['rows']} rows x{s['cols']} cols, duplicate {s['duplicate_pct']:g}% ({s['duplicate_rows']} rows)", None)]
        counts = {r["column"]: r for r in profile.column_counts(df, df.columns).collect()}
        texts += [(f"col:{c}", "column_semantic", f"Column {c} ({spec.kind(df, c)}): unique {counts[c]['unique'] if c in counts else 0} missing {counts[c]['missing_pct'] if c in counts else 0:g}%", c) for c in df.columns]
        for r in profile.missing_together(df).limit(top).collect():
            texts.append((f"rel:missingTogether:{r['a']}:{r['b']}", "relationship", f'Relationship: columns "{r["a"]}" and "{r["b"]}" missing together (correlation {r["coefficient"]:.2f}) in {dataset_id}', None))
        return knowledge.dataset_records(spark, workspace, dataset_id, texts, spec.file_name)

    return provide


def catalogue_provider(rows, kind: str, prefix: str, query: str, scan: int | None = None, keep: int = knowledge.CATALOG_KEEP) -> Provider:
    """The rows of a fixed table with most tokens of the query in name, family or text."""

    def provide(spark: SparkSession, workspace: str) -> DataFrame:
        tokens = tokens_of(query)
        scored = [(-sum(t in f"{r[1]} {r[2]} {r[3]}".lower() for t in tokens), k) for k, r in enumerate(rows[:scan])]
        return knowledge.catalogue(spark, workspace, kind, prefix, [rows[k] for _, k in sorted(scored)[:keep]])

    return provide


def dictionary_provider(query: str) -> Provider:
    return catalogue_provider(knowledge.DICTIONARY, "note", "dict::", query, knowledge.CATALOG_SCAN)


def functionality_provider(query: str) -> Provider:
    return catalogue_provider(knowledge.FUNCTIONALITIES, "functionality", "func::", query)


def corpus_provider(corpus: DataFrame, query: str, keep: int = knowledge.CATALOG_KEEP) -> Provider:
    """The capabilities of a corpus, of any size, with most tokens of the query in name, family or text: a bounded top-k on each partition."""

    def provide(spark: SparkSession, workspace: str) -> DataFrame:
        best = lexical.prefilter(corpus, F.concat_ws(" ", "name", "family", "about"), query, "place", None, keep)
        return knowledge.corpus_records(best, workspace)

    return provide


def functionality(key: str) -> tuple | None:
    """A capability by its key."""
    return next((r for r in knowledge.FUNCTIONALITIES if r[0] == key), None)


class RequestMemo:
    """Provider output reused within one request; a provider that fails gives nothing."""

    def __init__(self, spark: SparkSession, workspace: str):
        self.spark, self.workspace, self._made = spark, workspace, {}

    def get(self, name: str, provider: Provider) -> DataFrame:
        if name not in self._made:
            try:
                self._made[name] = provider(self.spark, self.workspace)
            except Exception:  # a search goes on without the provider
                self._made[name] = knowledge.empty_records(self.spark)
        return self._made[name]
