"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import toxicity

    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmark.llm import bpe

    args = (_tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    done = bpe.round_trip(table(spark, sf_dir, "documents"), *args)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import mpegts

    texts = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    done = mpegts.demux(mpegts.mux(texts))
    tail = F.substring("payload", -32, 32)
    return done.select("doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), mpegts.feature().alias("feature"), "pes_packets", "pts", "random_access")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import secrets

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", *map(count, secrets.KINDS[:3]), F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import mixing

    rounded = lambda c, digits: F.round(c, digits).alias(c)
    return mixing.mix(table(spark, sf_dir, "documents"), rate=0.5).select("doc_id", "source", "lang", "topic", "n_tokens", rounded("weight", 9), rounded("probability", 6), "sampled", rounded("residual", 6))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")).withColumn("over_limit", F.col("n_tokens") > 2048)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie at source/language/thousand/id; one that closes with a licence notice is a licence file.

    Licence files lie in such a directory or in one of the two above it, by their id, so files inherit from all levels.
    """
    from quillmark.llm import licenses

    docs = table(spark, sf_dir, "documents")
    closes = F.coalesce(F.substring_index("text", "\n", -1).rlike(licenses.TRIGGER), F.lit(False))
    levels = F.array(F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"))
    depth = F.when(closes, F.pmod("doc_id", F.lit(3)).cast("int") + 1).otherwise(3)
    path = F.concat_ws("/", F.slice(levels, 1, depth), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.select("doc_id", "text", path.alias("path")), licence_file=closes)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import langid

    return langid.detect(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import substring

    removed = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("bigint"), lambda n, r: n + r["ends"] - r["starts"])
    done = substring.deduplicated(table(spark, sf_dir, "documents"), words=50)
    return done.select("doc_id", "n_words", F.coalesce(removed, F.lit(0)).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import clusters

    return clusters.with_inertia(*clusters.cluster(table(spark, sf_dir, "embeddings"))).drop("measured")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmark.llm import audit

    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from quillmark.llm.oracles import ORACLES

    return dict(ORACLES)
