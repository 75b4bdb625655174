import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import substring
from tests.llm.conftest import ODD


def brute(rows, words=50):
    """(doc_id, words, removed, kept) of rows (doc_id, text)."""
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in cut:
        for p in range(len(w) - words + 1) if i is not None else ():
            key = tuple(w[p : p + words])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in cut:
        gone = set()
        for p in range(len(w) - words + 1) if i is not None else ():
            if first[tuple(w[p : p + words])] < i:
                gone |= set(range(p, p + words))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def found(df, **kw):
    rows = substring.deduplicated(df, **kw).collect()
    return sorted(((r["doc_id"], r["n_words"], sum(r["ends"] or []) - sum(r["starts"] or []), r["kept"]) for r in rows), key=str)


def corpus(seed=1, n=120):
    """Texts that share passages of many lengths at many places, copies, near copies and repetition."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(k)] for k in (12, 26, 49, 50, 51, 75, 100, 180)]
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(4)):
            p, at = rng.choice(passages), rng.randrange(len(text) + 1)
            text[at:at] = p if rng.random() < 0.7 else p[rng.randrange(9) :]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [(500 + k, rows[k][1]) for k in range(0, 40, 3)] + [(-1, rows[7][1]), (5, rows[9][1]), (5, rows[9][1]), (None, rows[11][1])]
    rows += [(600, "ab " * 400), (601, "ab " * 90 + "c"), (602, "a b " * 60), (603, "b a " * 60), (604, "A b " * 60)]
    return rows


@pytest.mark.parametrize(("words", "limit"), [(50, 1_000_000), (50, 0), (27, 1_000_000), (8, 1_000_000), (1, 1_000_000)])
def test_against_brute_force(spark, monkeypatch, words, limit):
    monkeypatch.setattr(substring, "BROADCAST_ROWS", limit)
    rows = corpus(words)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "hash", "starts", "kept", "digest", "anchors")})
    assert found(df.repartition(5), words=words) == brute(rows, words)


def test_odd_rows_and_empty_tables(odd, empty):
    assert found(odd) == brute([(i, t) for i, t, *_ in ODD])
    assert found(empty) == []


def test_lengths_double():
    assert substring.lengths(50) == [13, 25, 50] and substring.lengths(20) == [20] and substring.lengths(208) == [13, 26, 52, 104, 208]


def test_hashes_of_windows_tell_words_and_order_apart():
    h = np.random.default_rng(0).integers(0, 2**63, 400, dtype=np.uint64)
    for length in (1, 2, 3, 7, 13, 50):
        full = substring.doubled(h, length)
        assert len(full) == 401 - length
        assert (substring.doubled(h[5 : 5 + length], length) == full[5]).all()
        assert len(np.unique(full)) == len(full)
        if length > 1:
            assert substring.doubled(h[5 : 5 + length][::-1].copy(), length)[0] != full[5]
            assert (substring.doubled(h, length, 1) != full).all()
    for width in (1, 2, 3, 38, 64):
        assert (substring.least_in(h, width) == [h[k : k + width].min() for k in range(401 - width)]).all()


def test_few_windows_are_looked_up():
    """A thirteen-word stand-in holds for about twenty windows."""
    h = np.random.default_rng(0).integers(0, 2**63, 20_000, dtype=np.uint64)
    assert len(np.unique(substring.stand_ins(h, 13, 50))) < 0.07 * len(h)


def test_query_keeps_what_no_earlier_document_has(spark, small):
    from quillmark.llm import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op11_substring_dedup(spark, small).collect()), key=str)
    want = sorted(((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(docs)), key=str)
    assert got == want and sum(r[2] for r in got) > 0
