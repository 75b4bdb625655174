"""A training corpus from documents: language ID, near-duplicates, secrets, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents, whatever these are and however they are named.

Rows with null or empty texts have no language and go in the first stage.  Very long texts are read whole.  Null ids, and
rows that repeat an id, are rows of their own; of rows that repeat a text, the second stage keeps one.  An empty table
passes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, langid, mixing, neardup, secrets
from quillmark.llm.common import fresh, own_columns, table, written

#: Below this share no language stands out; a text in two of the languages has more.
LEAST_LANGUAGE_SCORE = 0.3
SAMPLE_RATE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no language; documents without a lang get the one that was found."""
    model = spark.sparkContext.broadcast(langid.fit(docs))
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = langid.tagged(docs, model, names=(pred, score)).filter((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return found.select(*(F.coalesce("lang", pred).alias(c) if c == "lang" else own for c, own in zip(docs.columns, own_columns(docs), strict=True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return neardup.without_copies(docs, words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found; all documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples half of the tokens at calibrated probabilities."""
    return mixing.sampled(docs, rate=SAMPLE_RATE)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and the digest of the decoded bytes."""
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, *args).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]

#: Minwise branching, the language model and BPE merges aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
