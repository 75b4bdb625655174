import pytest
from pyspark.sql import functions as F

from quillmark.functions.vectors import hashed_words
from quillmark.operators import batch, fusion, lexical, rerank, search, vector_index
from quillmark.operators.knowledge import records

NOTES = [
    ("r1", "Survival analysis estimates time until an event", "active"), ("r2", "Linear regression predicts a number", "active"), ("r3", "A t-test compares two means", "active"),
    ("r4", "Missing values were filled with the median", "active"), ("r5", "Rows with outliers were removed before", "superseded"), ("r6", "The chart shows revenue by month", "stale"),
    ("r7", "Customers are grouped by clustering", "active"), ("r8", "Entropy of a category column in bits", "active"),
]
GOLDEN = {"survival time event": "r1", "regression": "r2", "t-test means": "r3", "missing median": "r4", "revenue chart": "r6", "clustering customers": "r7", "entropy bits": "r8", "compare two means": "r3"}


@pytest.fixture(scope="module")
def notes(spark):
    df = spark.createDataFrame([(k, *n) for k, n in enumerate(NOTES)], "pos int, id string, text string, status string")
    made = records(df, id=F.col("id"), kind="note", text=F.col("text"), workspace=F.lit("w"), cell=F.col("id"), metadata={"status": F.col("status"), "column": F.when(F.col("id") == "r8", "category")}, provenance={"dataset_ids": F.when(F.col("pos") < 4, F.array(F.lit("d1"))), "cell_id": F.col("id")}, pos=F.col("pos"))
    return made.persist()


@pytest.mark.parametrize("query", GOLDEN)
def test_golden_recall(notes, query):
    found = search.search(notes, query, search.Request(workspace_id="w", limit=8), hashed_words(64))
    assert GOLDEN[query] in [r["id"] for r in found.orderBy("place").limit(3).collect()]


def test_filters(notes):
    ids = lambda **kw: {r["id"] for r in search.filtered(search.normalized(notes), search.Request(workspace_id="w", **kw).normalized("q")).collect()}
    assert "r5" not in ids() and "r5" in ids(include_superseded=True)
    assert ids(dataset_id="d1") == {"r1", "r2", "r3", "r4"}
    assert ids(column="category") == {"r8"}
    assert ids(kinds=("guide",)) == set()


def test_history_words_show_old_records():
    assert search.Request().normalized("what was it originally").include_superseded
    assert search.Request(kinds=("data_representative",)).normalized("q").limit == 12


def test_empty_query_and_scope(notes):
    rows = search.search(notes, " ", search.Request(workspace_id="w", limit=2)).collect()
    assert [(r["id"], r["score"]) for r in rows] == [("r1", 0.5), ("r2", 0.5)]
    assert search.search(notes, "regression", search.Request()).count() == 0


def test_failing_model_leaves_lexical_ranking(notes):
    def broken(_):
        raise RuntimeError("no model")

    found = search.search(notes, "regression", search.Request(workspace_id="w", limit=3), broken)
    assert "r2" in [r["id"] for r in found.collect()]


def test_active_cell_outranks(notes, spark):
    cells = spark.createDataFrame([(f"r{k}", k) for k in range(1, 9)], "id string, idx int")
    found = search.search(notes, "values", search.Request(workspace_id="w", cell_id="r6", limit=8, rerank=False), None, cells=cells)
    assert found.orderBy(F.desc("score")).first()["id"] == "r6"


def test_stored_records_win_over_provider_records(notes):
    other = notes.filter("id = 'r2'").withColumn("text", F.lit("regression from a provider"))
    found = search.search(notes, "regression", search.Request(workspace_id="w", limit=8), extra=[other])
    assert [r["text"] for r in found.filter("id = 'r2'").collect()] == ["Linear regression predicts a number"]


def test_ranks_are_stable(spark):
    df = spark.createDataFrame(list(enumerate([0.1, 0.9, 0.5, 0.9])), "pos int, s double")
    assert [r["pos"] for r in fusion.ranked(df, "s", "pos").orderBy("rank").collect()] == [1, 3, 2, 0]


def test_rrf(spark):
    df = spark.createDataFrame([(0, 4.0, 4.0), (1, 3.0, 1.0), (2, 2.0, 3.0), (3, 1.0, 2.0)], "pos int, a double, b double")
    order = [r["pos"] for r in fusion.fused(df, ["a", "b"], "pos").orderBy(F.desc("rrf")).collect()]
    assert order[0] == 0 and order.index(2) < order.index(1)
    alone = [r["pos"] for r in fusion.fused(df, ["a"], "pos").orderBy(F.desc("rrf")).collect()]
    assert alone == [0, 1, 2, 3]


def test_bm25_forms_agree(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, ""), (4, None)], "doc_id int, text string")
    one = {r["doc_id"]: r["bm25"] for r in lexical.bm25(docs.filter("text is not null"), ["beta", "alpha"]).collect()}
    queries = spark.createDataFrame([(7, "beta alpha")], "query_id int, query string")
    many = {r["doc_id"]: r["bm25"] for r in lexical.bm25_many(docs.filter("text is not null"), queries).collect()}
    assert one[1] > one[2] > one[3] == 0.0
    assert many == pytest.approx({k: v for k, v in one.items() if v})
    assert [r["bm25"] for r in lexical.bm25(docs, []).collect()] == [0.0] * 4


def test_feature_score(spark):
    df = spark.createDataFrame([(1, "missing values here"), (2, "values that are missing"), (3, "other")], "k int, text string")
    found = {r["k"]: r["f"] for r in df.select("k", rerank.feature_score(F.col("text"), "missing values").alias("f")).collect()}
    assert found == {1: 4.0, 2: 2.5, 3: 0.0}


def test_mmr_prefers_variety(spark):
    df = spark.createDataFrame([("a", 0.9, [1.0, 0.0], 0), ("b", 0.89, [1.0, 0.0], 1), ("c", 0.5, [0.0, 1.0], 2), ("d", 0.1, None, 3)], "id string, score double, vector array<float>, _pos int")
    assert [r["id"] for r in rerank.mmr(df, 2, "id").orderBy("place").collect()] == ["a", "c"]
    assert [r["id"] for r in rerank.mmr(df, 4, "id").orderBy("place").collect()] == ["a", "b", "c", "d"]


def test_other_reranker(notes):
    rerank.set_reranker(lambda pool, query: pool.withColumn("score", F.length("text").cast("double")))
    try:
        found = search.search(notes, "regression", search.Request(workspace_id="w", limit=1), None)
        assert found.count() == 1
    finally:
        rerank.set_reranker(None)


def test_recall(spark):
    golden = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, id string")
    ranked = spark.createDataFrame([(1, "a", 3), (2, "b", 4)], "query_id int, id string, place int")
    assert search.recall_at(golden, ranked, 3).first()["recall"] == 0.5


def test_topk_is_pushed_to_partitions(spark):
    vectors = spark.range(100).selectExpr("id as vec_id", "array(cast(id as float), 1f) as embedding")
    plan = search.vector_search(vectors, [1.0, 0.0])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omega sigma upsilon"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three documents of which only one has a vector; two passages longer than 60 characters, one of an odd number."""
    top = str(tmp_path_factory.mktemp("tables"))
    docs = [(0, f"Some words. {PASSAGE}. the and of that", "en", "src1"), (1, "upsilon the the and of that", "de", "src2"), (2, "of nothing else", "en", "src2")]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string"),
        "embeddings": ([(0, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int"),
        "labels": ([(0, 1, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, PASSAGE.replace(" ", "  ").upper()), (2, "nobody has these words in this order at all although they are many of them")], "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    return top


def test_documents_without_vector_are_ranked(spark, folder):
    from quillmark.plans import retrieval

    fused = {r["doc_id"]: r["rrf"] for r in retrieval.hybrid_rrf(spark, folder).collect()}
    bm25 = sorted(retrieval.bm25_all(spark, folder).collect(), key=lambda r: (-r["bm25"], r["doc_id"]))
    place = {r["doc_id"]: k + 1 for k, r in enumerate(bm25)}
    assert fused == pytest.approx({k: 1 / (61 + k) + 1 / (60 + place[k]) for k in range(3)}, abs=1e-8)
    assert {r["doc_id"] for r in retrieval.boosted_search(spark, folder).collect() if r["score"] is not None} == {0, 1, 2}


def test_batch_asks_with_whole_passages(spark, folder):
    from quillmark.plans import retrieval

    got = {(r["query_id"], r["doc_id"]): r["bm25"] for r in retrieval.bm25_batch(spark, folder).collect() if r["query_id"] == 1}
    assert set(got) == {(1, 0), (1, 1)}  # document 1 has only the last word of the passage
    for (_, doc), score in got.items():
        one = lexical.bm25(spark.read.parquet(f"{folder}/documents.parquet"), PASSAGE.split()).filter(F.col("doc_id") == doc).first()["bm25"]
        assert score == pytest.approx(one, abs=1e-6)


def test_recall_is_against_documents_that_hold_a_passage(spark, folder):
    from quillmark.plans import retrieval

    assert retrieval.recall_at_k(spark, folder).first().asDict() == {"queries": 1, "hits": 1, "recall": 1.0, "asked": 2}
    docs = spark.createDataFrame([(1, "x y z short one"), (2, "aa bb cc dd"), (3, f"zz {PASSAGE} zz"), (4, PASSAGE[:-8])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "short one"), (3, PASSAGE), (4, ""), (5, None)], "query_id long, query string")
    assert {(r["query_id"], r["id"]) for r in retrieval.holders(docs, bench).collect()} == {(1, 1), (3, 3)}


def test_features_order_the_pool(spark):
    df = spark.createDataFrame([("a", "beta only here", 3.0), ("b", "alpha beta", 1.0), ("c", "nothing", 9.0), ("d", "beta again", 5.0), ("e", "", 2.0)], "id string, text string, score double")
    got = {r["id"]: (r["rank"], r["features"], r["score"]) for r in rerank.by_features(df, "alpha beta beta", order="id").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1][0])] == ["b", "d", "a", "c", "e"]
    assert got["a"][1] == pytest.approx(4 / 3) and got["b"][1] == 2.5 and got["e"][1] == 0
    assert {r["features"] for r in rerank.by_features(df, "! ? .").collect()} == {0.0}
    picked = rerank.mmr(rerank.by_features(df, "alpha beta beta", order="id").withColumn("vector", F.lit(None).cast("array<float>")), 8, "id", pos="id", rank="rank")
    assert [r["id"] for r in picked.orderBy("place").collect()] == ["b", "d", "a", "c", "e"]  # a pool that fits keeps its order


def plain_mmr(rows, top, weight=0.7):
    """rows: (id, score, vector), best first."""
    import math

    def like(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return max(0.0, sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb)) if na and nb else 0.0

    left, out = list(rows), []
    while left and len(out) < top:
        value = [weight * s - (1 - weight) * max((like(v, w) for _, _, w in out), default=0.0) for _, s, v in left]
        out.append(left.pop(value.index(max(value))))
    return [i for i, _, _ in out]


def test_mmr_query_against_its_definition(spark):
    from quillmark.plans import retrieval

    sf = "/root/testdata/sf0.01"
    got = [r["vec_id"] for r in retrieval.mmr_select(spark, sf).orderBy("place").collect()]
    pool = retrieval.search.vector_search(spark.read.parquet(f"{sf}/embeddings.parquet"), retrieval._query_vector(spark, sf), rerank.POOL).collect()
    rows = sorted(((r["vec_id"], r["score"], list(r["embedding"])) for r in pool), key=lambda x: (-x[1], x[0]))
    assert got == plain_mmr(rows, 8)


def test_failing_model_gives_the_first_records(spark, notes):
    def fails(texts):
        raise RuntimeError("no model")

    def fails_later(texts):
        if texts == ["regression"]:
            return [[1.0, 0.0]]
        raise RuntimeError("no model")

    for embedder in (fails, fails_later):
        got = search.search(notes, "regression", search.Request(workspace_id="w", limit=3), embedder).orderBy("place").collect()
        assert len(got) == 3 and {r["score"] for r in got} == {search.FALLBACK}
    plain = search.search(notes, "  ", search.Request(workspace_id="w", limit=3))
    lexical = search.search(notes, "regression", search.Request(workspace_id="w", limit=3, rerank=False))
    assert plain.columns == lexical.columns == search.search(notes, "regression", search.Request(workspace_id="w")).columns == list(search.RESULT)


def test_history_words_count_anywhere():
    assert search.Request().normalized("what came beforehand").include_superseded and not search.Request().normalized("what is new").include_superseded


def test_many_queries_in_rounds(spark):
    vectors = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)] + [(99, None), (98, [1.0])], "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id < 9").selectExpr("vec_id as query_id", "embedding as query")
    want = {(r["query_id"], r["place"]): r["vec_id"] for r in search.vector_search_many(vectors, queries, 3).collect()}
    assert len(want) == 27 and want == {(r["query_id"], r["place"]): r["vec_id"] for r in search.vector_search_many(vectors, queries, 3, at_once=2).collect()}
    for q in (0, 5):
        one = search.vector_search(vectors.filter("vec_id < 60"), list(queries.filter(f"query_id = {q}").first()["query"]), 3).collect()
        assert [want[q, p] for p in (1, 2, 3)] == [r["vec_id"] for r in one]


def test_no_single_task_ranks_all_rows(spark):
    df = spark.range(2000).selectExpr("id as pos", "cast(id % 37 as double) as a", "cast(id % 11 as double) as b")
    plan = fusion.fused(df, ["a", "b"], "pos")
    assert plan.count() == 2000 and plan.selectExpr("max(rrf)").first()[0] <= 2 / 61
    assert "SinglePartition" not in fusion.ranked(df, "a", "pos").filter("rank > 5")._jdf.queryExecution().optimizedPlan().toString()


def test_system_knowledge_comes_after_the_stored_records(notes):
    asked = search.Request(workspace_id="w", limit=1000)
    ids = [r["id"] for r in search.search(notes, " ", asked).orderBy("place").collect()]
    stored = [k for k in ids if not k.startswith(("dict::", "func::"))]
    assert ids[: len(stored)] == stored and len(ids) > len(stored)
    without = search.search(notes, " ", search.Request(workspace_id="w", limit=1000, include_system=False))
    assert [r["id"] for r in without.orderBy("place").collect()] == stored


@pytest.mark.parametrize("first", [2, 64])
def test_pool_is_the_front_of_the_full_ranking(spark, first):
    """With ties, zeros and nulls in the lists, rows raised by few values, and queries of any number of rows."""
    import random

    rng = random.Random(first)
    rows = [(q, k, rng.choice([0.0, 0.0, None, rng.random()]), rng.choice([0.5, rng.random(), -1.0]), rng.choice([0.0, 0.15, 0.15, -0.1])) for q in range(4) for k in range([300, 150, 7, 1][q])]
    df = spark.createDataFrame(rows, "q int, pos int, a double, b double, up double").repartition(5)
    full = fusion.fused(df, ["a", "b"], "pos", query="q").withColumn("score", F.col("rrf") + F.col("up"))
    want = {}
    for r in full.collect():
        want.setdefault(r["q"], []).append((-r["score"], r["pos"], r["rrf"]))
    got = {}
    for r in fusion.pool(df, ["a", "b"], "pos", 9, raised=F.col("up"), query="q", first=first).collect():
        got.setdefault(r["q"], []).append((-r["score"], r["pos"], r["rrf"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x)[:9] for q, x in want.items()}
    one = df.filter("q = 0")
    whole = sorted((-r["rrf"], r["pos"]) for r in fusion.fused(one, ["a"], "pos").collect())[:30]
    assert sorted((-r["rrf"], r["pos"]) for r in fusion.pool(one, ["a"], "pos", 30, first=first).collect()) == whole
    assert fusion.pool(df.limit(0), ["a", "b"], "pos", 5).count() == 0


REQUESTS = [
    (1, "survival time event", "w", None, None, None, None, None, None), (2, "regression", "w", 3, None, None, None, None, None), (3, "values by a t-test", "w", 8, ["d1"], None, None, None, "r4"),
    (4, " ", "w", 2, None, None, None, None, None), (5, "what was removed before", "w", 4, None, None, None, None, None), (6, "category entropy", "w", 8, None, "category", None, None, None),
    (7, "anything", None, 8, None, None, None, None, None), (8, "median", None, 5, None, None, None, "all", None), (9, "zzz", "w", 4, None, None, ["guide"], None, None), (10, "qqq", "w", 3, None, None, None, None, "r6"),
    (11, "regression", "w", 1, None, None, ["note"], None, None),
]


@pytest.mark.parametrize(("embedder", "step"), [(None, 3), (hashed_words(64), 1)])
def test_many_searches_are_those_of_each(notes, spark, embedder, step):
    schema = "request_id long, query string, workspace_id string, limit int, dataset_ids array<string>, column string, kinds array<string>, scope string, cell_id string"
    got = {}
    for r in batch.search_many(notes, spark.createDataFrame(REQUESTS[::step], schema), embedder).collect():
        got.setdefault(r["request_id"], []).append((r["place"], r["id"], round(r["score"], 9)))
    for k, query, workspace, limit, datasets, column, kinds, scope, cell in REQUESTS[::step]:
        request = search.Request(workspace_id=workspace, limit=limit, dataset_ids=tuple(datasets or ()), column=column, kinds=tuple(kinds or ()), scope=scope or "workspace", cell_id=cell, include_system=False)
        want = [(r["place"], r["id"], round(r["score"], 9)) for r in search.search(notes, query, request, embedder).collect()]
        assert sorted(got.get(k, [])) == sorted(want), query


def test_many_searches_in_rounds_and_of_no_request(notes, spark):
    asked = spark.createDataFrame([(k, "regression median", "w") for k in range(5)], "request_id int, query string, workspace_id string")
    rows = batch.search_many(notes, asked, at_once=3).collect()
    assert len({(r["id"], r["place"], r["score"]) for r in rows}) == len(rows) / 5 > 0
    assert batch.search_many(notes, asked.limit(0)).count() == 0


def test_pruned_search_is_that_of_all_vectors(spark, tmp_path):
    """With copies, zero vectors, other widths, fewer vectors than asked for, and queries of zeros."""
    import numpy as np

    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 8))
    rows = [(k, [float(x) for x in middle[k % 20] + 0.05 * rng.normal(size=8)]) for k in range(2000)] + [(3000 + k, [float(x) for x in middle[3]]) for k in range(9)] + [(4000, [0.0] * 8), (4001, [1.0] * 3), (4002, None), (4003, [float("nan")] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = [(k, r[1]) for k, r in enumerate(rows[:2000:90])] + [(900, [0.0] * 8), (901, [1.0, -1.0] * 4)]
    queries = spark.createDataFrame(asked, "query_id long, query array<double>")
    index = vector_index.VectorIndex.build(vectors, str(tmp_path / "index"), 8, pivots=25)
    got, met = index.search(queries, 6)
    want = search.vector_search_many(vectors.filter("vec_id != 4003"), queries, 6)
    key = lambda df: sorted((r["query_id"], r["place"], r["vec_id"], r["score"]) for r in df.collect() if r["query_id"] < 900)
    assert key(got) == key(want)
    assert {(r["query_id"], r["place"], r["vec_id"]) for r in got.collect()} == {(r["query_id"], r["place"], r["vec_id"]) for r in want.collect()}
    assert sum(r["n"] for r in met.collect() if r["query_id"] < 900) < 0.3 * 2000 * 23
    few = vector_index.VectorIndex.build(vectors.filter("vec_id < 3"), str(tmp_path / "few"), 8)
    assert key(few.search(queries, 6)[0]) == key(search.vector_search_many(vectors.filter("vec_id < 3"), queries, 6))
    none = vector_index.VectorIndex.build(vectors.limit(0), str(tmp_path / "none"), 8)
    assert none.search(queries, 6)[0].count() == 0


def brute_search(notes, query, limit, dim=64, cell=None):
    """The whole search of current notes of a workspace, in plain Python."""
    import math

    from quillmark.functions.text import expanded, merged_terms, tokens_of

    docs = [(k, i, t, status) for k, (i, t, status) in enumerate(notes) if status != "superseded"]
    base = tokens_of(query)
    terms = merged_terms(base, expanded(base))
    cut = {k: tokens_of(t) for k, _, t, _ in docs}
    average = max(1.0, sum(map(len, cut.values())) / len(docs))
    df = {t: sum(t in w for w in cut.values()) for t in set(terms)}
    idf = {t: max(0.0, math.log(1 + (len(docs) - n + 0.5) / (n + 0.5))) for t, n in df.items()}
    bm = {k: sum(idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / average)) for t in terms) for k, w in cut.items()}
    vectors = dict(zip(cut, hashed_words(dim)([t for _, _, t, _ in docs]).astype(float), strict=True))
    q = hashed_words(dim)([query])[0].astype(float)
    unit = lambda v: v / math.sqrt(float(v @ v)) if v.any() else v
    dense = {k: round(float(unit(v) @ unit(q)), 12) for k, v in vectors.items()}
    rank = lambda score: {k: n for n, k in enumerate(sorted(score, key=lambda k: (-score[k], k)), 1)}
    by_bm, by_dense = rank(bm), rank(dense)
    raised = {k: {"active": 0.15, "stale": 0.05}[s] + (0.6 if i == cell else 0.0) for k, i, _, s in docs}
    score = {k: 1 / (60 + by_bm[k]) + 1 / (60 + by_dense[k]) + raised[k] for k in cut}

    def features(text):
        words, phrase = tokens_of(text), query.strip().lower()
        at = [words.index(t) for t in base if t in words]
        if not words or not base:
            return 0.0
        near = 0.5 if len(base) > 1 and len(at) == len(base) and max(at) - min(at) <= 10 else 0.0
        return 2.0 * len(at) / len(base) + (1.5 if len(phrase) > 3 and phrase in text.lower() else 0.0) + near

    text = {k: t for k, _, t, _ in docs}
    pool = sorted(cut, key=lambda k: (-features(text[k]), -score[k], k))[:24]
    final = {k: score[k] + features(text[k]) for k in pool}
    picked = []
    while len(picked) < min(limit, len(pool)):
        if len(pool) <= limit:
            picked = list(pool)
            break
        like = lambda k: max([0.0, *(float(unit(vectors[k]) @ unit(vectors[j])) for j in picked)])
        picked.append(max((k for k in pool if k not in picked), key=lambda k: (0.7 * final[k] - 0.3 * like(k), -pool.index(k))))
    name = {k: i for k, i, _, _ in docs}
    return [(n, name[k], round(final[k], 6)) for n, k in enumerate(picked, 1)]


@pytest.mark.parametrize(("query", "limit", "cell"), [("compare the means of a t-test", 3, None), ("missing values median", 8, None), ("revenue by month", 4, "r6"), ("std of categories", 2, "r1")])
def test_full_search_against_brute_force(notes, query, limit, cell):
    found = search.search(notes, query, search.Request(workspace_id="w", limit=limit, cell_id=cell, include_system=False), hashed_words(64))
    assert sorted((r["place"], r["id"], round(r["score"], 6)) for r in found.collect()) == brute_search(NOTES, query, limit, cell=cell)


def test_a_model_with_a_cache_embeds_each_text_once(notes, spark, tmp_path):
    from quillmark.functions.vectors import EmbeddingModel
    from quillmark.sources.knowledge_store import EmbeddingCache

    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    model = EmbeddingModel(name="words-64", dimension=64)
    request = search.Request(workspace_id="w", limit=3, include_system=False)
    rows = lambda df: sorted((r["place"], r["id"], r["score"]) for r in df.collect())
    first = rows(search.search(notes, "regression number", request, model, cache=cache))
    assert cache.count() == 7  # the superseded note isn't a candidate

    def never(texts):
        assert texts == ["regression number"]
        return model.embedder()(texts)

    only_query = EmbeddingModel(name="words-64", dimension=64, make=lambda _: never)
    assert rows(search.search(notes, "regression number", request, only_query, cache=cache)) == first == rows(search.search(notes, "regression number", request, model.embedder()))


def test_errors_that_are_not_the_models_are_raised(notes):
    """A text column that can't be read is no failing model."""
    broken = notes.withColumn("text", F.when(F.lit(True), F.raise_error(F.lit("lost file"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost file"):
        search.search(broken, "regression", search.Request(workspace_id="w", limit=3, include_system=False), hashed_words(8)).collect()


def test_nearest_of_odd_vectors_are_those_of_the_plain_expression(spark):
    """Copies, zeros, nulls, NaN, infinity, huge and tiny vectors, scaled ones, as rows and as queries."""
    import numpy as np
    from pyspark.sql.window import Window

    from quillmark.functions.vectors import cosine

    rng = np.random.default_rng(3)
    some = [[float(x) for x in rng.normal(size=4)] for _ in range(150)]
    odd = [[0.0] * 4, [-0.0] * 4, [None, 1.0, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 1.0], [1e200, 1.0, 1.0, 1.0], [1e-200, 0.0, 1e-200, 0.0], some[5], [2 * x for x in some[5]], None, [1.0, 2.0]]
    rows = list(enumerate(some + odd + odd + [some[5]] * 30 + odd * 5))
    vectors = spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.filter("vec_id % 3 = 0 or vec_id between 150 and 172").selectExpr("concat('q', vec_id) as query_id", "embedding as query")
    pairs = vectors.crossJoin(queries).filter("size(embedding) = size(query)").withColumn("score", cosine(F.col("embedding"), F.col("query")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "vec_id"))
    key = lambda df: sorted((r["query_id"], r["place"], r["vec_id"], repr(r["score"])) for r in df.collect())
    assert key(search.vector_search_many(vectors, queries, 4)) == key(pairs.withColumn("place", place).filter("place <= 4"))
    names = vectors.select(F.concat(F.lit("v"), "vec_id").alias("vec_id"), "embedding")
    assert search.vector_search_many(names, queries, 4).join(pairs.select("query_id", F.concat(F.lit("v"), "vec_id").alias("vec_id"), F.col("score").alias("s")), ["query_id", "vec_id"]).filter("not score <=> s").count() == 0


def test_nearest_makes_no_row_for_each_pair(spark):
    from quillmark.operators import nearest

    vectors = spark.range(3000).selectExpr("id as vec_id", "array(sin(id), cos(id), sin(2 * id)) as embedding").repartition(2)
    (chunk,) = nearest.chunks(vectors.filter("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding as query"), 1000)
    assert nearest.nearest(vectors, spark.sparkContext.broadcast(chunk), 5, "embedding", "vec_id").count() == 2 * 300 * 5


def test_many_bm25_scores_are_made_where_texts_lie(spark, monkeypatch):
    """In tiles of two queries and three texts; queries without tokens, of one id, and texts without any."""
    import math

    monkeypatch.setattr(lexical, "QUERIES", 2)
    monkeypatch.setattr(lexical, "DOCUMENTS", 3)
    words = ["alpha", "beta", "gamma", "delta", "c++", "x"]
    docs = spark.createDataFrame([(k, " ".join(words[(k * j) % 6] for j in range(k % 7))) for k in range(40)] + [(90, None), (91, "! ?")], "doc_id long, text string").repartition(3)
    asked = [(1, "beta alpha beta"), (2, "nobody"), (3, "c++ delta x"), (4, ""), (5, None), (6, "gamma"), (7, "alpha"), (7, "gamma")]
    got = lexical.bm25_many(docs, spark.createDataFrame(asked, "query_id long, query string"))
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r["query_id"], r["doc_id"]): r["bm25"] for r in got.collect()}
    filled, n = docs.filter("text is not null"), 42
    want = {}
    for q, text in {1: "beta alpha beta", 3: "c++ delta x", 6: "gamma", 7: "alpha gamma"}.items():
        tf = {r["doc_id"]: r["t"] for r in filled.select("doc_id", lexical.tokenize(F.col("text")).alias("t")).collect()}
        average = sum(map(len, tf.values())) / len(tf)
        for t in lexical.tokens_of(text):
            df = sum(t in x for x in tf.values())
            for d, x in tf.items():
                if t in x:
                    f = x.count(t)
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    want[q, d] = want.get((q, d), 0.0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / average))
    assert rows == pytest.approx(want)
    best = {(r["query_id"], r["doc_id"]): r["bm25"] for r in lexical.bm25_many(docs.coalesce(1), spark.createDataFrame(asked, "query_id long, query string"), digits=3, best=2).collect()}
    near = {k: math.floor(v * 1000 + 0.5) / 1000 for k, v in rows.items()}
    for q in (1, 3, 6, 7):
        top = sorted((k for k in near if k[0] == q), key=lambda k: (-near[k], k))[:2]
        assert set(top) <= set(best) and all(best[k] == near[k] for k in top)


def test_recall_ranks_no_more_than_the_best_of_each_task(spark, folder, monkeypatch):
    from quillmark.plans import retrieval

    asked, made = [], lexical.bm25_many
    monkeypatch.setattr(lexical, "bm25_many", lambda *args, **options: asked.append(options) or made(*args, **options))
    assert retrieval.recall_at_k(spark, folder).first()["hits"] == 1
    assert asked == [{"digits": 6, "best": 3}]


def _most_rows(spark, since):
    """The most rows that any step of the executions from a number on has put out."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    executions = store.executionsList()
    for k in range(executions.size()):
        e = executions.apply(k)
        if e.executionId() >= since:
            values = store.executionMetrics(e.executionId())
            for m in (e.metrics().apply(j) for j in range(e.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).split("\n")[-1].split(" ")[0].replace(",", "")))
    return most


def test_a_batch_makes_no_row_for_each_pair_and_is_that_of_its_sql(spark, tmp_path, monkeypatch):
    """Few words, so that many scores are equal or differ by rounding alone; null texts, languages and sources; requests in turns."""
    import random

    import duckdb

    from quillmark.plans import retrieval

    for name, value in (("ROWS", 500), ("COUNTS", 3000), ("AT_ONCE", 17)):
        monkeypatch.setattr(batch, name, value, raising=False)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(9)]
    docs = [(k, None if k % 97 == 0 else " ".join(rng.choices(words, k=rng.choice([0, 4, 7, 10]))), rng.choice(["en", "de", None]), rng.choice(["src1", "src9", None])) for k in range(5000)]
    asked = [(k, " ".join(rng.choices([*words, "nobody"], k=k % 6)) if k % 7 else " ! ") for k in range(48)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = sorted(tuple(r) for r in retrieval.search_batch(spark, str(tmp_path)).collect())
    assert 5000 <= _most_rows(spark, since) < 5000 * 48 / 4
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        want = sorted(db.sql(retrieval.SEARCH_BATCH).fetchall())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-9)


def test_requests_without_text_share_their_first_candidates(spark):
    rows = spark.range(3000).select("*", F.lit("some text").alias("text"))
    own = records(rows, id=F.col("id"), kind="note", text=F.col("text"), workspace=F.lit("w"), metadata={}, provenance={}, pos=-F.col("id")).persist()
    asked = spark.createDataFrame([(k, " ", "w" if k else "v", k % 5) for k in range(40)], "request_id int, query string, workspace_id string, limit int")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = sorted((r["request_id"], r["place"], r["id"]) for r in batch.search_many(own, asked).collect())
    assert got == [(k, n, str(3000 - n)) for k in range(1, 40) for n in range(1, k % 5 + 1)]
    assert _most_rows(spark, since) < 3000 * 40 / 4


def test_pools_of_a_batch_are_the_front_of_the_full_ranking(spark, monkeypatch):
    """By two lists, with pools larger than what is taken first, copies, texts without tokens and records raised by status and cell."""
    import random

    from quillmark.functions.text import tokens_of
    from quillmark.functions.vectors import cosine, embed

    for name, value in (("ROWS", 50), ("COUNTS", 100), ("AT_ONCE", 2)):
        monkeypatch.setattr(batch, name, value, raising=False)
    rng, model = random.Random(5), hashed_words(16)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choices(words, k=k % 9)), rng.choice(["active", "stale", None]), f"c{k % 3}") for k in range(700)]
    df = spark.createDataFrame(rows, "pos int, text string, status string, cell string").repartition(3)
    own = records(df, id=F.concat(F.lit("r"), "pos"), kind="note", text=F.col("text"), workspace=F.lit("w"), cell=F.col("cell"), metadata={"status": F.col("status")}, provenance={}, pos=F.col("pos")).persist()
    asked = [(1, "w1 w2 w2", 200, "c1"), (2, "w3", 5, None), (3, "w5 w6 w7", 90, None), (4, "nobody", 30, "c2"), (5, "?", 70, None)]
    requests = spark.createDataFrame([(*r, "w", False) for r in asked], "request_id int, query string, limit int, cell_id string, workspace_id string, expand boolean")
    found = {}
    for r in batch.pools(own, batch.prepared(requests), model).collect():
        found.setdefault(r["request_id"], []).append((-round(r["score"], 12), r["_order"], r["id"]))
    known = embed(own, "text", model)
    for k, query, limit, cell in asked:
        vector = F.array(*(F.lit(float(x)) for x in model([query])[0]))
        scored = lexical.bm25(own, sorted(tokens_of(query)), "id").join(known, "text").withColumn("bm25", F.round("bm25", 9)).withColumn("dense", F.coalesce(cosine(F.col("vector"), vector), F.lit(0.0)))
        ranked = fusion.fused(scored, ["dense", "bm25"], "_pos")
        up = fusion.boost(F.col("metadata.status"), own_cell=F.col("cell_id") == cell, source_cell=F.col("cell_id") == cell)
        want = sorted((-round(r["score"], 12), str(r["_pos"]).zfill(20) + r["id"], r["id"]) for r in ranked.withColumn("score", F.col("rrf") + up).collect())
        assert sorted(found[k]) == want[: max(limit, 24)], query
