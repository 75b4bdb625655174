import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm import mixing, queries, token_counts, topk
from tests.llm.conftest import ODD, by_id

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_odd_rows(odd, empty):
    rows = by_id(token_counts.count_tokens(odd, PATH))
    assert {k: (r["n_bytes"], r["n_tokens"]) for k, r in rows.items()} == {i: (len((t or "").encode()), count(t)) for i, t, *_ in ODD}
    assert token_counts.count_tokens(empty, PATH).count() == 0


def test_token_counts_with_tiny_blocks(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    token, n = np.array([5, 9, 2, 70_000]), np.array([1, 2, 300, 4])
    a, b = token_counts.unpack(token_counts.pack(token, n))
    assert (a == token).all() and (b == n).all()
    twice = docs.unionByName(docs)
    rows = token_counts.count_tokens(twice, PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == 120 and all(r["n_tokens"] == count(texts[r["doc_id"]]) for r in rows)


def test_token_query(spark, small):
    docs = by_id(spark.read.parquet(f"{small}/documents.parquet"))
    rows = by_id(queries.op8_token_counts(spark, small))
    assert rows.keys() == docs.keys()
    assert all((r["n_tokens"], r["over_limit"]) == (count(docs[k]["text"]), count(docs[k]["text"]) > 2048) for k, r in rows.items())


def brute(rows, k=5, scale=256):
    ok = [(i, [int(c) for c in np.floor(scale * np.array(v, np.float32).astype(np.float64))]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in ok if i % 50 == 0}):
        q = next(v for j, v in ok if j == i)
        near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if len(v) == len(q) and j != i)
        out += [(i, r, j, -s) for r, (s, j) in enumerate(near[:k], 1)]
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **kw).collect())


@pytest.mark.parametrize("block", [64, 4096])
def test_top_k_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.2, (700, 12)).astype(np.float32)
    x[100:400] = x[100]  # ties: the smallest ids win
    x[7] = 0
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    assert found(spark, rows) == brute(rows)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (1, [1.0, 2.0]), (2, [3.0]), (200, [1.0]), (None, [1.0, 1.0]), (3, [1e12, -1e12]), (250, [])]
    got = found(spark, rows)
    assert {r[:1] for r in got} == {(0,), (200,)}
    assert got == brute(rows)
    assert found(spark, []) == []


def test_huge_components_take_part(spark):
    """Scores beyond 64 bits are ranked as they are and returned as the nearest that fits."""
    rows = [(0, [1e20, 1.0]), (1, [1e20, 0.0]), (2, [3e20, 0.0]), (3, [-1e30, 5.0]), (4, [-2e30, 5.0]), (5, [0.5, 0.5]), (50, [0.0, 1.0]), (6, [3e38, 1.0]), (7, [3e20, 0.0])]
    got = found(spark, rows, k=8)
    long = 2**63 - 1
    want = [(q, r, v, max(-long - 1, min(long, s))) for q, r, v, s in brute(rows, k=8)]
    assert got == want and [v for q, _, v, _ in got if q == 0][:4] == [6, 2, 7, 1]


def test_repeated_ids_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 600)  # a few queries each
    monkeypatch.setattr(topk, "BLOCK", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, (400, 4)).astype(np.float32)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    assert found(spark, rows) == brute(rows)
    twice = [*rows, *rows[1:50]]  # candidates with one id are rows of their own
    got = found(spark, twice)
    assert [r for r in got if r[0] == 50] == [r for r in brute(twice) if r[0] == 50]


def test_lists_are_read_until_bounds_decide():
    """Where one component decides, the lists' heads are enough; where none does, they're read to a great part, and the result is the same."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 30, (3000, 8)))
    x[:, 2] = np.floor(rng.pareto(1.0, 3000) * 500)
    for query, most in ((np.eye(8)[2] * 90 + 1, 0.15), (np.full(8, 100.0), 1.0), (-np.eye(8)[1] * 3, 0.15), (np.zeros(8), 0.0)):
        block = topk.Block(np.arange(3000), x, 5)
        got, taken = block.best(query, 6)
        exact = np.sort(block.x @ query)[::-1][:6]
        assert sorted((s for s, _ in got), reverse=True)[:6] == exact.tolist()
        assert taken <= most * block.lists.size
    assert (np.diff(block.values, axis=1) >= 0).all()


def test_read_share_is_counted(spark, small):
    """On vectors without structure most of the lists must be read: what no-random-access costs there."""
    read, there = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = topk.top_k(df, F.col("vec_id") % 50 == 0, counters=(read, there)).collect()
    assert len(rows) == 50 and 0 < read.value <= there.value


def fit_by_loop(cells, goals, rounds=200):
    w = {c: t / sum(cells.values()) for c, t in cells.items()}
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            now = {}
            for c, x in w.items():
                now[c[d]] = now.get(c[d], 0) + x
            w = {c: x * goal[c[d]] / now[c[d]] for c, x in w.items()}
    return w


def test_raking_meets_all_marginals(spark):
    cells = {("s1", "en", "a"): 70, ("s1", "de", "a"): 10, ("s2", "en", "b"): 5, ("s2", "de", "a"): 15, ("s1", "en", "b"): 9}
    df = spark.createDataFrame([(*c, t) for c, t in cells.items()], "source string, lang string, topic string, n_tokens long")
    goals = [{"s1": 0.5, "s2": 0.5}, {"en": 0.6, "de": 0.4}, {"a": 0.7, "b": 0.3}]
    targets = {d: spark.createDataFrame(list(g.items()), "value string, target double") for d, g in zip(mixing.DIMENSIONS, goals, strict=True)}
    fitted, _, change = mixing.rake(df, targets, rounds=60)
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in fitted.collect()}
    assert got == pytest.approx(fit_by_loop(cells, goals), abs=1e-6) and change < 1e-6
    chances = mixing.with_probability(fitted, 0.4).collect()
    assert sum(r["n_tokens"] * r["probability"] for r in chances) == pytest.approx(0.4 * 109)
    assert max(r["probability"] for r in chances) <= 1


def test_mixing_odd_rows(odd, empty):
    rows = by_id(mixing.mix(odd))
    assert len(rows) == 9 and rows[3]["source"] == "(none)" and rows[2]["n_tokens"] == 0
    assert mixing.sampled(odd).columns == odd.columns
    assert {r["doc_id"] for r in mixing.sampled(odd).collect()} == {k for k, r in rows.items() if r["sampled"]}
    assert mixing.mix(empty).count() == 0 and mixing.sampled(empty).count() == 0


def test_mixing_query_meets_its_rate(spark):
    rows = queries.op5_mixing(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    assert sum(r["n_tokens"] * r["probability"] for r in rows) == pytest.approx(0.5 * sum(r["n_tokens"] for r in rows), rel=1e-4)


@pytest.mark.parametrize("lowers", [True, False])
def test_plain_words_follow_the_file(tmp_path, lowers):
    """A tokenizer file that keeps cases must not have its words lowered."""
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    if not lowers:
        spec["normalizer"] = None
    own = tmp_path / "own.json"
    own.write_text(json.dumps(spec))
    cutter, library = token_counts.PreTokenizer(str(own)), Tokenizer.from_file(str(own))
    for text in ("Hello", "hello", "ABC"):
        assert sum(map(cutter.count, cutter._cut(text))) == len(library.encode(text, add_special_tokens=False).ids)


def test_pre_tokenizer_that_keeps_spaces_is_refused():
    with pytest.raises(ValueError, match="white space"):
        token_counts.PreTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_targets_that_cannot_be_met_are_reported(spark):
    df = spark.createDataFrame([(1, "x" * 4000, "a", "en"), (2, "x" * 4000, "b", "de"), (2, "x" * 4000, "b", "de"), (None, None, None, None)], "doc_id long, text string, source string, lang string")
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, target double"), "lang": spark.createDataFrame([("en", 0.8), ("de", 0.2)], "value string, target double")}
    with pytest.warns(UserWarning, match="misses its target"):
        rows = mixing.mix(df, targets=targets).collect()
    assert len(rows) == 4 and all(r["residual"] == pytest.approx(0.3) for r in rows)
    crossed = spark.createDataFrame([(k, "x" * (1200 + 400 * k), s, x) for k, (s, x) in enumerate((s, x) for s in "ab" for x in ("en", "de"))], "doc_id long, text string, source string, lang string")
    assert all(r["residual"] < 1e-9 for r in mixing.mix(crossed).select("residual").collect())


def test_many_cells_give_the_same(spark, monkeypatch, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = by_id(mixing.mix(docs))
    monkeypatch.setattr(mixing, "SMALL_CELLS", 0)
    for k, r in by_id(mixing.mix(docs)).items():
        assert r["probability"] == pytest.approx(want[k]["probability"], abs=1e-9) and r["weight"] == pytest.approx(want[k]["weight"], abs=1e-10)


def test_sampled_keeps_clashing_names(spark):
    df = spark.createDataFrame([(1, "x" * 400, "a", "en"), (1, "x" * 400, "a", "en")], "doc_id long, text string, source string, lang string").withColumns({c: F.lit("clash") for c in ("_source", "_lang", "_topic", "_probability", "cell_source", "cell_lang", "CELL_topic", "cell_probability", "residual")})
    assert mixing.sampled(df, rate=1.0).columns == df.columns and mixing.sampled(df, rate=1.0).count() == 2
