import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillmark.llm import licenses, neardup, queries
from tests.llm.conftest import by_id

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=260):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 5)))
    passage = [word() for _ in range(40)]
    texts = [[word() for _ in range(rnd.randint(1, 60))] for _ in range(n // 3)]
    texts += [[*passage, *[word() for _ in range(rnd.randint(5, 120))]] for _ in range(n // 3)]
    origin = [word() for _ in range(80)]
    while len(texts) < n:
        copy = list(origin if rnd.random() < 0.6 else rnd.choice(texts))
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(len(copy))] = word()
        texts.append(copy)
    rnd.shuffle(texts)
    return [(k + 1, rnd.choice([" ", "\n", "\t "]).join(w.upper() if rnd.random() < 0.1 else w for w in t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "size", "small"), [(1, 4, 48), (2, 5, 4)])
def test_components_against_brute_force(spark, seed, size, small):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(df, words=size, small=small, max_depth=5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, size)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("block", [16, 4096])
def test_blocks_of_large_leaves_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_DEPTH", 1)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(df, words=4, small=0).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4)


def test_links_between_components():
    import numpy as np

    sets = [np.arange(10), np.arange(1, 11), np.arange(50, 60), np.arange(9), np.arange(51, 60)]
    labels = [b"a", b"b", b"c", b"a", b"d"]
    assert set(neardup.linked_components([b"0", b"1", b"2", b"3", b"4"], labels, sets, 80)) == {(b"1", b"0"), (b"2", b"4"), (b"4", b"2")}
    assert neardup.linked_components([], [], [], 80) == []


def test_odd_rows(spark, odd, empty):
    rows = by_id(neardup.near_duplicates(odd))
    assert (rows[2]["n_shingles"], rows[3]["component_id"], rows[8]["kept"]) == (0, 3, True)
    assert rows[4]["component_id"] == 1 and not rows[4]["kept"] and rows[7]["n_shingles"] == 1
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.without_copies(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == set(range(1, 10)) - {4}
    repeated = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z")], "doc_id long, text string")
    assert neardup.near_duplicates(repeated).count() == 4


def test_chain_of_labels(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["v"]: r["label"] for r in neardup.components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}


def test_near_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op7_near_duplicates(spark, small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, 4)


FILES = [
    (1, "proj/LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction. The MIT License."),
    (2, "proj/src/a.py", "# SPDX-License-Identifier: Apache-2.0\nprint(1)"),
    (3, "proj/src/deep/b.py", "print(2)"),
    (4, "proj/src/deep/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (5, "proj/src/deep/er/c.py", None),
    (6, "other/d.py", "the licence of this is unclear"),
    (7, None, "Licensed under CC BY-NC 4.0."),
    (8, "proj/e.py", ""),
    (8, "proj/e.py", ""),
]


def test_licenses_are_found_and_inherited(spark):
    df = spark.createDataFrame(FILES, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = {(r["doc_id"], r["license"], r["origin"], r["from_dir"]) for r in licenses.scan(df).collect()}
    assert got == {
        (1, "MIT", "header", None), (2, "Apache-2.0", "header", None), (3, "GPL-3.0", "inherited", "proj/src/deep"), (4, "GPL-3.0", "header", None), (5, "GPL-3.0", "inherited", "proj/src/deep"),
        (6, None, None, None), (7, "CC-BY-NC-4.0", "header", None), (8, "MIT", "inherited", "proj"),
    }
    assert licenses.scan(df).count() == 9


def test_license_odd_rows(odd, empty):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    assert licenses.scan(odd.withColumn("path", path)).count() == 9
    assert licenses.scan(empty.withColumn("path", path)).count() == 0


def test_license_query(spark, small):
    rows = by_id(queries.op9_licenses(spark, small))
    docs = by_id(spark.read.parquet(f"{small}/documents.parquet"))
    said = {"Apache-2.0": "Apache License, Version 2.0", "MIT": "the MIT License", "GPL-3.0": "GNU General Public License, version 3", "CC-BY-NC-4.0": "CC BY-NC 4.0"}
    for k, r in rows.items():
        own = {name for name, text in said.items() if text in (docs[k]["text"] or "")}
        assert (r["license"] in own) if own else r["origin"] != "header"
    plan = queries.op9_licenses(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", plan)


def test_deep_branching_keeps_pairs_together(spark):
    """Pairs at the least similarity still share a node of some tree at the greatest depth."""
    rnd = random.Random(5)
    token, rows = lambda: rnd.randrange(2**31), []
    for k in range(300):
        sig = [token() for _ in range(neardup.FUNCTIONS)]
        rows += [(f"{k}a".encode(), sig), (f"{k}b".encode(), [x if rnd.random() < 0.8 else token() for x in sig])]
    join = object.__new__(neardup.Joiner)
    join.classes = spark.createDataFrame(rows, "fp binary, sig array<int>").persist()
    level = neardup.written(join.shared(join.root(10)), "members")
    for _ in range(9):
        level = neardup.written(join.shared(join.branched(level)), "members")
    assert level.select(F.expr("substring(cast(fp as string), 1, length(fp) - 1)").alias("pair")).distinct().count() == 300


def test_large_nodes_by_prefixes_against_brute_force(spark, monkeypatch):
    """One passage stands in most documents: nodes stay large, and no block may hold them."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "MOST_BLOCKS", 1)
    rnd = random.Random(6)
    passage = [f"p{k}" for k in range(60)]
    rows = corpus(5, 120) + [(1000 + k, " ".join([*passage, *(f"w{rnd.randrange(400)}" for _ in range(rnd.randint(10, 30)))])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for depth in (1, 3):
        got = neardup.near_duplicates(df, words=4, small=0, max_depth=depth).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4)


def test_one_row_of_each_group_stays(spark):
    a, b, c = "a b c d e f g", "u v w x y z q r", "one two three four five six"
    rows = [(5, a, 0), (1, a, 1), (5, b, 2), (7, c, 3), (7, c, 3), (7, c, 4), (None, a, 5), (None, "lone words stay here as they are", 6), (None, "", 7), (None, "", 7), (None, None, 8), (9, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long").withColumns({"digest": F.lit("clash"), "stays": F.lit(True), "text_digest": F.lit(1), "row_hash": F.lit(2), "m": F.create_map(F.lit("k"), F.lit(1))})
    got = neardup.without_copies(df)
    assert got.columns == df.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (7, c), (None, "lone words stay here as they are"), (None, ""), (None, ""), (None, None), (9, None)], key=str)
    unnamed = spark.createDataFrame([(None, a, 1), (None, a, 2), (3, a, 3)], "doc_id long, text string, n long")
    assert [r["n"] for r in neardup.without_copies(unnamed).collect()] == [3]
    assert neardup.without_copies(unnamed.filter("doc_id is null")).count() == 1


def leaf_pairs(spark, members):
    """remaining_pairs of members (node, fp, label), whose labels are what is known so far."""
    join = neardup.Joiner.__new__(neardup.Joiner)
    rows = spark.createDataFrame([(n, bytes(f), bytes(c)) for n, f, c in members], "node long, fp binary, label binary")
    join.labels = rows.select(F.col("fp").alias("v"), "label").distinct()
    return join.remaining_pairs(rows.select("node", "fp"))


def test_leaf_pairs_against_brute_force(spark):
    rng = random.Random(4)
    label = {f: rng.choice([b"a", b"a", b"b", b"c", b"%d" % f]) for f in range(60)}
    members = [(node, b"%02d" % f, label[f]) for node in range(12) for f in rng.sample(range(60), rng.randrange(1, 25))]
    want = {(min(x[1], y[1]), max(x[1], y[1])) for x in members for y in members if x[0] == y[0] and x[2] != y[2]}
    got = [(bytes(r["a"]), bytes(r["b"])) for r in leaf_pairs(spark, members).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_hot_leaf_costs_its_size_times_those_outside(spark):
    """A group of 60,000 copies with three others: 180,003 pairs, where all against all would be 3.6 billion rows."""
    members = [(1, b"%08d" % k, b"group" if k > 2 else b"%08d" % k) for k in range(60_003)]
    start = time.time()
    assert leaf_pairs(spark, members).count() == 180_003
    assert time.time() - start < 60
