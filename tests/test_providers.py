import pytest
from pyspark.sql import functions as F

from quillmark.functions.vectors import hashed_words
from quillmark.operators import knowledge, providers, search
from quillmark.operators.profile import DatasetSpec
from quillmark.sources import knowledge_store


@pytest.fixture(scope="module")
def people(spark):
    rows = [(k, 20.0 + k % 7, "ab"[k % 2], None if k % 3 else "x", None if k % 3 else "y") for k in range(30)]
    return spark.createDataFrame(rows, "k long, age double, team string, p string, q string")


SPEC = DatasetSpec("people.csv", order=("k",))


def test_dataset_upgrades_in_place(spark, people):
    before = {r["id"]: r["text"] for r in providers.dataset_provider(people, SPEC, "d", profiled=False)(spark, "w").collect()}
    after = {r["id"]: r["text"] for r in providers.dataset_provider(people, SPEC, "d")(spark, "w").collect()}
    assert before.keys() == after.keys() and "dataset:d:rep:0" in after
    assert before["dataset:d:col:age"] == 'Column "age" is numeric'
    assert after["dataset:d:col:age"].startswith('Column "age" (numeric): missing 0.0% unique 7, mean 22.') and "entropy 1.00" in after["dataset:d:col:team"]
    assert providers.dataset_provider(None, SPEC, "d")(spark, "w").count() == 0


def test_wide_datasets_keep_every_column(spark):
    df = spark.range(20).select(*(F.col("id").alias(f"c{k}") for k in range(30)))
    texts = dict(providers.column_texts(df, DatasetSpec("wide.csv")))
    assert len(texts) == 30 and "mean" in texts["c0"] and texts["c29"] == 'Column "c29" is numeric'


def test_relations(spark, people):
    found = {r["id"]: r["text"] for r in providers.relationship_provider(people, SPEC, "d")(spark, "w").collect()}
    assert "rel:d:missingTogether:p:q" in found and "correlation 1.00" in found["rel:d:missingTogether:p:q"]
    assert found["rel:d:candidateKeys"].startswith("Relationship: candidate key columns [k] uniquely")
    assert "p, q" in found["rel:d:highMissing"]
    plain = {r["id"]: r["text"] for r in providers.plain_records(people, SPEC, "d")(spark, "w").collect()}
    assert plain["dataset:d:profile"] == "Dataset people.csv profile: 30 rows x5 cols, duplicate 0% (0 rows)"


def test_catalogues_are_bounded(spark):
    found = providers.functionality_provider("compare the means of two groups")(spark, "w")
    assert found.count() <= 12 and found.orderBy("_pos").first()["id"] == "func::t-test"
    assert providers.dictionary_provider("")(spark, "w").count() == len(knowledge.DICTIONARY)
    assert providers.functionality("anova")[1] == "Analysis of variance" and providers.functionality("none") is None


def test_memo_and_failing_provider(spark):
    calls = []

    def provider(s, w):
        calls.append(w)
        raise RuntimeError

    memo = providers.RequestMemo(spark, "w")
    assert memo.get("x", provider).count() == 0 and memo.get("x", provider).count() == 0 and calls == ["w"]


def test_token_chunks(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "k int, t string")
    got = providers.token_chunks(df, "k", "t", lambda s: [ord(c) for c in s.replace(" ", "")], lambda i: "".join(map(chr, i)), 4, 1)
    assert [(r["k"], r["chunk"], r["text"]) for r in got.orderBy("k", "chunk").collect()] == [(1, 0, "abcd"), (1, 1, "defg"), (2, 0, "")]
    assert providers.rows_of_chunks(2, [1, 2, 3]) == [[1, 2], [3]]


def test_knowledge_store(spark, people, tmp_path):
    store = knowledge_store.KnowledgeStore(spark, str(tmp_path / "k"))
    store.put(providers.dataset_provider(people, SPEC, "d", profiled=False)(spark, "w"))
    store.put(providers.dataset_provider(people, SPEC, "d")(spark, "w"))
    assert store.by_workspace("w").count() == store.all().count() == store.by_dataset("d").count() == 8
    assert store.by_column("age").count() == 1 and store.by_notebook("nb:w").count() == 8 and store.by_cell("c").count() == 0
    hit = search.search(store.all(), "age mean", search.Request(workspace_id="w", limit=3), hashed_words(32))
    assert "dataset:d:col:age" in [r["id"] for r in hit.collect()]
    store.remove("dataset:d:profile")
    assert store.all().count() == 7 and store.by_source_hash("no").count() == 0
    assert store.clear_workspace("w").count() == 0


def test_vector_store_and_embedding_cache(spark, tmp_path):
    vectors = knowledge_store.VectorStore(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([("u", "h1", "a", "w", "note", "t", [1.0, 0.0]), ("u", "h2", "b", "w", "guide", "t", [0.0, 1.0]), ("x", "h1", "a", "w", "note", "t", [1.0, 0.0])], "uid string, content_hash string, id string, workspace_id string, kind string, text string, embedding array<float>").withColumn("used_at", F.current_timestamp())
    vectors.upsert(rows)
    vectors.upsert(rows)
    assert vectors.all("u").count() == 2 and vectors.all("u", "other").count() == 0
    assert [r["id"] for r in vectors.search("u", [1.0, 0.1]).collect()] == ["a", "b"]
    assert [r["id"] for r in vectors.search("u", [1.0, 0.1], kinds=("guide",)).collect()] == ["b"]
    assert vectors.delete_content("u", "h1").count() == 2
    cache = knowledge_store.EmbeddingCache(spark, str(tmp_path / "e"), most=2)
    cache.set("m", spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "text string, vector array<float>"))
    assert cache.has("m", "a") and not cache.has("other", "a")
    cache.touch("m", spark.createDataFrame([("a",)], "text string"))
    cache.set("m", spark.createDataFrame([("c", [3.0])], "text string, vector array<float>"))
    assert cache.count() == 2 and cache.has("m", "a") and cache.has("m", "c")
    assert cache.invalidate("m").count() == 0


def test_memo_expires():
    now = [0.0]
    memo = knowledge_store.TtlMemo(10, lambda: now[0])
    memo.put("u", "s", "k", 1)
    assert memo.get("u", "s", "k") == 1
    now[0] = 11
    assert memo.get("u", "s", "k") is None


def test_a_catalogue_in_tables(spark):
    """Overlays and guides come after, flags reach the text and the line, a group that isn't there has its own name."""
    methods = spark.createDataFrame([("t", "t-test", "cmp", "Compares two means.", 0), ("t", "again", "cmp", "x", 5), ("f", "Forecast", "gone", None, 1), (None, "no key", "cmp", "y", 2)], "key string, label string, group string, summary string, place int")
    groups = spark.createDataFrame([("cmp", "Comparison", "tests/means")], "group string, label string, ui_path string")
    overlays = spark.createDataFrame([("up", "guide", "Upload", "Start", "Drop a file.", "upload", 0), ("t", "functionality", "late", "z", "z", "z", 1)], "key string, kind string, name string, family string, about string, ui_path string, place int")
    flags = spark.createDataFrame([("f",), ("f",), ("none",)], "key string")
    rows = {r["key"]: r for r in knowledge.corpus(methods, groups, overlays, flags).collect()}
    assert {k: (r["name"], r["family"], r["ui_path"], r["verified"], r["kind"]) for k, r in rows.items()} == {"t": ("t-test", "Comparison", "tests/means", True, "functionality"), "f": ("Forecast", "gone", "analyse", False, "functionality"), "up": ("Upload", "Start", "upload", True, "guide")}
    assert rows["f"]["about"] == " Find it at analyse. Note: experimental, its verification is pending."
    best = providers.corpus_provider(knowledge.corpus(methods, groups, overlays, flags), "means of a file", 2)(spark, "w")
    assert [r["id"] for r in best.orderBy("_pos").collect()] == ["func::t", "func::up"]
    assert knowledge.corpus(methods.limit(0), groups).count() == 0
