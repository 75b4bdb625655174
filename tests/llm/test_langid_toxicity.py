import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillmark.llm import langid, queries, toxicity
from quillmark.llm.common import fold_of
from tests.llm.conftest import by_id

SF = "/root/testdata/sf0.01"


def test_fold():
    assert fold_of(17) == zlib.crc32(b"17") % 4


def test_language_held_out_accuracy(spark):
    docs = by_id(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = queries.op10_language_id(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == docs.keys()
    assert all(r["held_out"] == (fold_of(r["doc_id"]) == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.98 * len(held)


def test_words_come_before_ngrams():
    import numpy as np

    model = langid.Model(["a", "b"], ["ox"], np.array([[-1.0, -2.0]], np.float32), ["x", "^y"], np.array([[-5.0, -1.0], [-1.0, -3.0]], np.float32))
    scorer = langid.Scorer(model)
    assert scorer.word("ox").tolist() == [-1.0, -2.0]
    assert scorer.word("yx").tolist() == [-1.0, -3.0]  # the longer gram wins
    assert scorer.word("qx").tolist() == [-5.0, -1.0]
    assert scorer.word("qq") is None
    assert scorer.score(["ox 1!", "42 --", "", "qq"])[0] == ["a", "und", "und", "a"]


def test_language_odd_rows(spark, odd, empty):
    model = spark.sparkContext.broadcast(langid.fit(odd))
    rows = by_id(langid.identify(odd, model))
    assert [rows[k]["lang_pred"] for k in (2, 3, 5, 8)] == ["und"] * 4 and len(rows) == 9
    assert rows[1]["lang_pred"] == rows[4]["lang_pred"] and rows[1]["score"] == rows[4]["score"]
    assert langid.detect(empty).count() == 0
    none = spark.sparkContext.broadcast(langid.fit(empty))
    assert by_id(langid.identify(odd, none))[1]["lang_pred"] == "und"
    assert langid.tagged(odd, model).columns == [*odd.columns, "_lang_pred", "_lang_score"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = ["idiot", "moron", "scum", "disgusting", "worthless"]
    automaton = toxicity.LexiconAutomaton(terms)
    words = ["idiot", "id1ot", "idiott", "diot", "iditt", "scum", "scam", "scums", "disgustin", "dsgusting", "disgustig", "dsgustig", "wortless", "worthles", "moro", "mroon", "the", "", "i", "orthless", "disgust"]
    for word in words:
        near = sorted((distance(word, t), t) for t in terms if distance(word, t) <= toxicity.tolerance(t))
        assert automaton.match(word) == ((near[0][1], near[0][0]) if near else None), word
    small = toxicity.LexiconAutomaton(terms, most_states=5)
    assert [small.match(w) for w in words] == [automaton.match(w) for w in words]


def test_context_separates_quotation():
    scorer = toxicity.Scorer(toxicity.Model(terms={"idiot": 0.9}))
    abuse, quoted, reported, none = (s[0] for s in scorer.score(["you idiot", 'he used the word "idiot" there', "she wrote idiot once", "fine text"]))
    assert abuse > reported > quoted > none
    assert abuse >= toxicity.THRESHOLD > none


def test_toxicity_held_out(spark):
    labels = by_id(spark.read.parquet(f"{SF}/labels.parquet"))
    rows = queries.op1_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]["toxic"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == t for p, t in held) >= 0.93 * len(held)
    assert sum(p and not t for p, t in held) <= 0.02 * len(held)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    from quillmark.llm.common import fold

    flipped = labels.withColumn("toxic", F.when(fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (one.terms, one.stems, one.variants, one.rest) == (two.terms, two.stems, two.variants, two.rest)


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    rows = by_id(toxicity.detect(odd, labels))
    assert len(rows) == 9 and rows[3]["finds"] == 0
    assert toxicity.detect(odd, labels.limit(0)).count() == 9
    assert toxicity.detect(empty, labels).count() == 0


@pytest.mark.parametrize("text", ["you are an id1ot", "what a moronn"])
def test_misspellings_are_caught(text):
    scorer = toxicity.Scorer(toxicity.Model(terms=dict.fromkeys(toxicity.BASE_TERMS, 0.95)))
    assert scorer.score([text])[0][0] >= toxicity.THRESHOLD


def test_misspellings_of_learned_terms_are_caught(spark):
    """Of terms in no fixed list; no beginning of a single word is a stem; ordinary words near a term are left alone."""
    import random

    rnd = random.Random(4)
    plain = lambda: " ".join("".join(rnd.choice("aeioubcdfg") for _ in range(7)) for _ in range(12))
    rows, labels = [], []
    for k in range(300):
        toxic = k % 3 == 0
        word = rnd.choice(["snollygoster", "blatherer"]) if toxic else "slatherer" if k % 2 else "harmless"
        rows.append((k, f"{plain()} {word} {plain()}"))
        labels.append((k, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {"snollygoster", "blatherer"} <= set(model.terms) - set(toxicity.BASE_TERMS) and not model.stems
    scorer = toxicity.Scorer(model)
    caught = scorer.score(["the znollygoster came", "the zn0llygoster came", "a bl4therer too"])
    assert all(s[0] >= toxicity.THRESHOLD and s[2] == 1 for s in caught)
    assert scorer.score(["a slatherer of paint"])[0][:2] == (model.rest, 0)


def test_stems_against_edit_distance():
    terms, stems = ["idiot", "lower"], {"lowei", "vequ", "disgust"}
    automaton = toxicity.LexiconAutomaton([*terms, *stems], stems)
    words = ["lowei", "loweischaft", "loewischaft", "loweschaft", "vequant", "vecuant", "lower", "lowet", "disgusting", "disqusting", "idiots", "", "v", "lowe", "dizgust", "dizzgustx"]
    for word in words:
        near = [(distance(word, t), t) for t in terms] + [(min(distance(word[:n], t) for n in range(len(word) + 1)), t) for t in stems]
        near = sorted((e, t) for e, t in near if e <= toxicity.tolerance(t))
        assert automaton.match(word) == ((near[0][1], near[0][0]) if near else None), word


def plain_score(model, text):
    """Score by its definition: distances to every term, windows by slices."""
    def best(word):
        near = [(distance(word, t), t, model.terms[t]) for t in model.terms if abs(len(t) - len(word)) <= 2]
        near += [(min(distance(word[:n], t) for n in range(min(len(word), len(t) + 2) + 1)), t, p) for t, p in model.stems.items()]
        near = sorted((e, t, p) for e, t, p in near if e <= toxicity.tolerance(t))
        if not near:
            return None
        e, t, p = near[0]
        if not e:
            return (word, False, model.terms[word], word) if word in model.terms else (word, False, p, t)
        if word in model.variants:
            return (word, True, min(p, model.variants[word]), t) if model.variants[word] >= toxicity.TERM_PRECISION else None
        return word, True, min(p, model.unseen.get(t, toxicity.BASE_PRECISION) * 0.8 ** (e - 1)), t

    tokens = text.split()
    finds = []
    for at, token in enumerate(tokens):
        for word in toxicity.words_of(token.lower()):
            if (found := best(word)) is not None:
                finds.append((*found[:2], min(0.995, found[2] * toxicity.Scorer._context(tokens, at)), found[3]))
    if not finds:
        return model.rest
    clean = (1 - model.rest) * (1 - max((p for _, variant, p, _ in finds if variant), default=0.0))
    exact = {}
    for word, variant, p, _ in finds:
        if not variant:
            exact[word] = max(p, exact.get(word, 0.0))
    for p in exact.values():
        clean *= 1 - p
    if len(finds) > 1:
        return 1 - clean
    word, variant, _, term = finds[0]
    single = lambda kind: model.single.get(f"{kind}:{term}", model.single[kind])
    exact = single("insult" if term in toxicity.BASE_TERMS else "learned")
    return min(1 - clean, exact, single("masked" if re.search("[0-9_]", word) else "misspelled") if variant else 1.0)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_an_insult_weighs_no_less_than_its_misspelling(spark, scale):
    docs, labels = (spark.read.parquet(f"/root/testdata/{scale}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    for term in toxicity.BASE_TERMS:
        bent = [term[:k] + c + term[k + 1 :] for k in range(1, len(term)) for c in "01x"] + [term[:2] + term[3:], term + "z"]
        exact, *others = (s[0] for s in scorer.score([f"you {w}" for w in (term, *bent)]))
        assert all(exact >= x for x in others) and exact >= toxicity.THRESHOLD


def test_rows_that_repeat_an_id_with_other_texts_stay_in_the_sample(spark):
    rows = [(1, k, " ".join(f"w{k}x{j}" for j in range(9))) for k in range(4)] + [(0, 9, "a b c d e f g"), (0, 9, "h i j k l m n"), (0, 10, "a b c d e f g")]
    sample = spark.createDataFrame([(t, x, i) for t, i, x in rows], "toxic int, text string, doc_id bigint")
    got = sorted(r["text"] for r in toxicity._without_copies(sample).collect())
    assert got == sorted(x for t, i, x in rows if i != 10)


def test_scores_against_their_definition(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(docs, labels)
    model.stems = {"lowei": 0.9, "achlich": 0.8, "erre": 0.7}  # the sample is too small for stems
    model.variants = {"ther": 0.2, "moronn": 0.9}
    texts = [r["text"] or "" for r in docs.collect()]
    texts = [t for t in texts if len(t) < 4000][:60] + ["you moronn", 'he said "idiot" then', "m0ron and scum", "a scum", ""]
    got = [s[0] for s in toxicity.Scorer(model).score(texts)]
    assert got == pytest.approx([plain_score(model, t) for t in texts])


def test_each_part_decides_documents(spark):
    """Without the automaton planted misspellings are lost, without the windows planted quotations are taken for abuse."""
    import random

    rnd = random.Random(7)
    plain = lambda: " ".join("".join(rnd.choice("aeioubcdfg") for _ in range(6)) for _ in range(10))
    rows, labels = [], []
    for k in range(600):
        rows.append((k, f"{plain()} {rnd.choice(['snollygoster', 'blatherer']) if k % 3 == 0 else 'harmless'} {plain()}"))
        labels.append((k, int(k % 3 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    bent = [f"{plain()} you {w} {plain()}" for w in ("snolygoster", "snollygosterr", "sn0llygoster", "blathherer", "blaterer", "bletherer") for _ in range(5)]
    quoted = [f'{plain()} he wrote the word "{w}" there {plain()}' for w in ("snollygoster", "blatherer") for _ in range(10)]

    class Exact(toxicity.Scorer):
        def kind(self, word):
            found = super().kind(word)
            return None if found and found[0] == "variant" else found

    class Windowless(toxicity.Scorer):
        @staticmethod
        def _context(tokens, at):
            return 1.0

    flagged = lambda kind, texts: sum(s[0] >= toxicity.THRESHOLD for s in kind(model).score(texts))
    assert flagged(toxicity.Scorer, bent) == 30 and flagged(Exact, bent) == 0
    assert flagged(toxicity.Scorer, quoted) == 0 and flagged(Windowless, quoted) == 20
    assert flagged(toxicity.Scorer, [f"{plain()} you blatherer {plain()}"] * 3) == 3


def test_numbers_are_no_letters(spark, odd):
    model = spark.sparkContext.broadcast(langid.fit(odd))
    df = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ ① 12"), (3, "½a"), (4, "Hello"), (4, "Hello")], "doc_id long, text string")
    got = langid.identify(df, model).collect()
    assert [(r["lang_pred"] == "und", r["score"] == 0) for r in got] == [(True, True)] * 2 + [(False, False)] * 3 and got[3] == got[4]
    assert langid.words_of("a½b ²c x_y") == ["a", "b", "c", "x", "y"]


def plain_language(docs):
    """Counts, logs and backoff by their definitions, in dictionaries."""
    import math
    from collections import Counter

    import regex

    words = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    grams = lambda w, n: [f"^{w}$"[k : k + n] for k in range(len(w) + 3 - n)] if n > 1 else list(w)
    languages = sorted({lang for _, _, lang in docs if lang})
    w, g = {x: Counter() for x in languages}, {x: Counter() for x in languages}
    for i, t, lang in docs:
        if lang and fold_of(i) != 2:
            w[lang].update(words(t))
    for x in languages:
        for word, n in w[x].items():
            for k in range(1, 6):
                for gram in grams(word, k):
                    g[x][gram] += n
    known = {x for lang in languages for x, n in w[lang].items() if n >= 2}
    parts = {x for lang in languages for x, n in g[lang].items() if n >= 3}
    cut = lambda c, least: {x: (n if n >= least else 0) for x, n in c.items()}
    w, g = {x: cut(w[x], 2) for x in languages}, {x: cut(g[x], 3) for x in languages}
    total = {x: sum(w[x].get(y, 0) + 0.5 for y in known) for x in languages}
    totals = {(x, k): sum(g[x].get(y, 0) + 0.5 for y in parts if len(y) == k) for x in languages for k in range(1, 6)}

    def logs(word):
        if word in known:
            return [math.log((w[x].get(word, 0) + 0.5) / total[x]) for x in languages]
        for k in range(5, 0, -1):
            own = [y for y in grams(word, k) if y in parts]
            if own:
                return [sum(math.log((g[x].get(y, 0) + 0.5) / totals[x, k]) for y in own) / len(own) for x in languages]
        return None

    def predict(text):
        found = words(text)
        if not found:
            return "und", 0.0
        scored = [x for x in map(logs, found) if x]
        mean = [sum(x[k] for x in scored) / max(1, len(scored)) for k in range(len(languages))]
        share = [math.exp(m - max(mean)) for m in mean]
        return languages[share.index(1.0)], 1 / sum(share)

    return {i: predict(t) for i, t, _ in docs}


def test_languages_against_their_definition(spark, small):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = plain_language(docs)
    for r in queries.op10_language_id(spark, small).collect():
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4), r


def test_a_hundred_thousand_labels(spark):
    """Rates are a table, not an expression for each label; the model has fewer terms then, but as many as it can."""
    df = spark.range(100_000).selectExpr("id AS doc_id", "concat('l', id) AS lang", "concat('word', id, ' and some more') AS text")
    sample, labels = langid._sampled(df.select("doc_id", F.col("lang").alias("label"), "text"), "label", 10)
    assert len(labels) == 100_000 and sample.count() == 100_000
    assert len(sample._jdf.queryExecution().optimizedPlan().toString()) < 5000


def test_terms_that_tie_fill_what_is_left(spark):
    counts = spark.createDataFrame([("a", "t", 5), ("a", "z", 2), ("a", "y", 2), ("b", "y", 2), ("a", "x", 1)], "label string, term string, n long")
    kept = lambda most: {(r["label"], r["term"]) for r in langid._kept(counts, most)}
    assert kept(0) == set() and kept(1) == {("a", "t")} and kept(3) == {("a", "t"), ("a", "y"), ("b", "y")} and len(kept(9)) == 5
    assert len(langid._kept(counts.filter("n = 2"), 2)) == 2
