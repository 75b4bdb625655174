import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import coerce, text, vectors


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


def test_missing_values(spark):
    values = [None, "", " \t", "-", " N/A ", "NULL", "none", "Unknown", "not available", "NaN", "0", "x"]
    assert column(spark, values, coerce.is_missing) == [True] * 9 + [False] * 3


def test_rounding_goes_up_at_half(spark):
    assert column(spark, [-2.5, 2.5, 1.005, -0.5], coerce.js_round, "double") == [-2.0, 3.0, 1.0, 0.0]


def test_numbers(spark):
    values = ["1", " 2.5 ", "1e3", "0x1F", "", "1d", "abc", None, "-.5", "1e999"]
    assert column(spark, values, coerce.to_number) == [1.0, 2.5, 1000.0, 31.0, 0.0, None, None, None, -0.5, None]


def test_value_kinds(spark):
    assert column(spark, ["12", "2024-01-02", "2024-01-02T03:04:05Z", "x", "n/a", None], coerce.value_kind) == ["numeric", "date", "date", "string", None, None]


def test_tokens(spark):
    assert column(spark, ["A+B f# two-way x Z 42"], text.tokenize) == [["a+b", "f#", "two-way", "42"]]
    assert text.tokens_of("A+B f# two-way x Z 42") == ["a+b", "f#", "two-way", "42"]


@pytest.mark.parametrize(("token", "one", "many"), [("queries", "query", None), ("boxes", "box", None), ("means", "mean", None), ("class", None, None), ("mean", None, "means"), ("query", None, "queries"), ("col", None, None)])
def test_singular_and_plural(spark, token, one, many):
    assert (text.singular_of(token), text.plural_of(token)) == (one, many)
    assert column(spark, [token], text.singular) == [one]
    assert column(spark, [token], text.plural) == [many]


def test_singular_of_tokens_that_are_all_ending(spark):
    want = {"shes": "sh", "ches": "ch", "sses": "ss", "ties": "tie", "series": "sery"}
    assert column(spark, list(want), text.singular) == list(want.values()) == [text.singular_of(t) for t in want]


def test_expansion_is_bounded():
    assert text.expanded(["sd", "means"]) == ["standard", "deviation", "mean"]
    assert text.expanded(["rmse", "ci"]) == ["root", "mean", "square", "error", "rmses", "confidence"]
    assert text.expanded(["corr"]) == ["correlation", "corrs"]
    assert len(text.expanded([f"word{k}" for k in range(9)])) == 6
    assert len(set(text.merged_terms([f"a{k}" for k in range(50)], ["b"]))) == 50
    assert text.merged_terms(["a"], ["b", "a", "c"], most=2) == ["a", "b"]


@pytest.mark.parametrize("n", [0, 1, 2048, 2049, 3896, 3897, 9000])
def test_chunks_cover_the_text(spark, n):
    whole = "".join(chr(97 + k % 26) for k in range(n))
    pieces = column(spark, [whole], text.chunks)[0]
    assert len(pieces) == 1 if n <= 2048 else all(len(p) == 2048 for p in pieces[:-1])
    assert pieces[0] + "".join(p[200:] for p in pieces[1:]) == whole


def test_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 1.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, [1.0], [1.0, 1.0])], "k int, a array<float>, b array<float>")
    rows = df.orderBy("k").select(vectors.cosine(F.col("a"), F.col("b")).alias("s"), vectors.cosine_or_zero(F.col("a"), F.col("b")).alias("z")).collect()
    assert [None if r["s"] is None else round(r["s"], 6) for r in rows] == [0.707107, None, None]
    assert [round(r["z"], 6) for r in rows] == [0.707107, 0.0, 1.0]


def test_each_text_is_embedded_once(spark, tmp_path):
    df = spark.createDataFrame([("a b",), ("a b",), (None,), ("c",)], "text string")
    rows = vectors.embed(df, "text", vectors.hashed_words(16)).collect()
    assert sorted(r["text"] for r in rows) == ["a b", "c"]
    lengths = {r["text"]: sum(x * x for x in r["vector"]) for r in rows}
    assert lengths == pytest.approx({"a b": 0.0, "c": 0.0})  # words of one character are no tokens


@given(st.text(max_size=40))
def test_tokens_are_long_enough(value):
    assert all(len(t) > 1 and t == t.lower() for t in text.tokens_of(value))


def test_embedding_model():
    try:
        assert vectors.configure_embeddings(name="x/MiniLM-L6", chunk_tokens=4096).chunk_tokens == 512
        assert vectors.configure_embeddings(name="long-reader", chunk_tokens=4096, dimension=16).chunk_tokens == 4096
        assert vectors.embedding_model().embedder()(["a word"]).shape == (1, 16)
    finally:
        assert vectors.reset_embeddings() == vectors.embedding_model() == vectors.EmbeddingModel()


def test_long_texts_are_pooled():
    assert vectors.windows("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"] and vectors.windows("", 4, 1) == [""]
    made = vectors.pooled(lambda texts: np.array([[len(t), 1.0] for t in texts]), 4, 1)(["abcdefghij", "ab", ""])
    assert np.allclose(made, [[4 / 17**0.5, 1 / 17**0.5], [2, 1], [0, 1]])


@settings(deadline=None, max_examples=8, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aZz09+#- .,\n\tÀéİK\U0001f600", max_size=30), min_size=1, max_size=20))
def test_tokens_are_what_splitting_leaves(spark, texts):
    before = lambda c: F.filter(F.split(F.lower(c), text.SPLIT), lambda t: F.length(t) > 1)
    assert column(spark, [*texts, None], text.tokenize) == column(spark, [*texts, None], before)


def test_tokens_are_matched_not_split(spark):
    plan = spark.range(1).select(text.tokenize(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "filter(" not in plan
