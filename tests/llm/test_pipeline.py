import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import bpe, secrets
from tests.llm.conftest import SCHEMA, by_id


def test_stage_by_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).checkpoint()
        assert docs.columns == columns
        seen[name] = by_id(docs)
    first, second, third, fourth = (seen[name] for name, _ in corpus_pipeline.STAGES[:-1])
    assert len(first) >= len(second) == len(third) > len(fourth) > 0
    assert all(secrets.MASK in third[k]["text"] for k in third if third[k]["text"] != second[k]["text"])
    last = by_id(corpus_pipeline.run(spark, small))
    assert last.keys() == fourth.keys()
    coder = bpe.ByteBPE(bpe.load_ranks(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")), corpus_pipeline.public_tokenizers.PATTERN)
    assert all(coder.decode(np.frombuffer(r["ids"], "<u4")).decode() == fourth[k]["text"] for k, r in last.items())


def test_odd_and_empty_tables(spark, odd, small):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).checkpoint()
    assert docs.count() <= 9
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).checkpoint()
    assert docs.count() == 0


def test_clean_documents_stay(spark, small):
    docs = spark.createDataFrame([(1, "the and of that was is", None, "s", 22), (2, "12 34", "en", "s", 5), (3, "der und die das", "de", "s", 15)], SCHEMA)
    train = spark.read.parquet(f"{small}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100)
    got = by_id(corpus_pipeline.language_id(spark, docs.unionByName(train), small))
    assert got[1]["lang"] == "en" and 3 in got and 2 not in got


NAMES = ["we`ird", "a.b", "_doc", "_clean", "found", "fate", "text_digest", "row_hash", "spans", "base", "lang_pred", "lang_score", "topic", "weight", "probability", "n_tokens", "sampled", "part", "cell", "label", "sp ace", "``", "_rate"]


def test_columns_of_any_name_in_every_stage(spark, small, odd):
    """Backticks, dots, blanks and the names that stages use: all but the last stage hand them on as they are."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.limit(120).unionByName(docs.limit(5)).unionByName(odd.select(*docs.columns))
    docs = docs.select("*", *(F.lit(n).alias(n) for n in NAMES)).checkpoint()
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, small).checkpoint()
        assert docs.count() <= before.count() and docs.count() > 0, name
        if name != "byte_bpe":
            assert docs.columns == before.columns
            assert all(list(r)[-len(NAMES) :] == NAMES for r in docs.collect()), name
