import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.llm import audit
from tests.llm.conftest import ODD, SCHEMA

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """(part, id, letters failed) of each row (doc_id, text, part)."""
    out = []
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mask = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        copy = i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in rows)
        out.append((part or "", i, mask + "E" * copy))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    out, removed_by = {}, Counter()
    found = fails(rows)
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, _, _ in found}:
            alive = [x for x in found if x[0] == part]
            before = []
            for step, letter in enumerate(order, 1):
                gone = [x for x in alive if letter in x[2]]
                alive = [x for x in alive if letter not in x[2]]
                out[part, order, step] = [len(alive), len(gone), sum(letter in x[2] for x in before), sum(x[0] == part and x[2] == letter for x in found), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)]
                before += gone
                removed_by[part, letter] += len(gone)
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    rows = df.collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}


LONG = " ".join(f"w{k}" for k in range(250))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (None, LONG, "b"), (None, LONG, None), (4, "SHOUT " * 210, "a"), (5, "SHOUT " * 210, None),
    (6, LONG + " #", "c"), (7, LONG + " X" * 40, "c"), (8, None, "c"), (9, "", ""), (-3, "", "a"), (10, "a\x0bb\x1cc é  D", "b"), (11, LONG.upper() + " | " * 300, "b"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, 1, 1), (8, None, 1), (9, 0, 0), (None, 1, 1), (99, 1, 1)]


def test_every_order_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, source string, mask string")
    assert got(audit.audit(df, spark.createDataFrame(MARKS, LABELS))) == brute(ROWS, MARKS)


def test_odd_rows_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1)], LABELS)
    assert got(audit.audit(odd.withColumn("part", F.lit(1)).withColumn("good", F.lit("clash")), labels)) == brute([(i, t, s) for i, t, _, s, _ in ODD], [(1, 1, 0), (4, 1, 1)])
    assert audit.audit(empty, labels).count() == 0
    nothing = spark.createDataFrame([], LABELS)
    assert got(audit.audit(odd, nothing)) == brute([(i, t, s) for i, t, _, s, _ in ODD], [])


def test_a_hot_text_is_counted_before_it_meets_others(spark):
    """A text of many rows is a row for each part and label when texts are joined."""
    rows = spark.range(4000).selectExpr("id AS doc_id", "'same' AS text", "concat('s', id % 2) AS source")
    found = audit.audit(rows, spark.createDataFrame([], LABELS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = {r["part"]: r for r in found.filter("filter_order = 'EABCD' and step = 1").collect()}
    assert (rows["s0"]["removed"], rows["s1"]["removed"]) == (1999, 2000)


@pytest.mark.parametrize("letters", ["AE", "ABE"])
def test_other_sets_of_filters(spark, letters):
    """Fewer filters: two to the power of their number of cells, as many orders as there are permutations."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    own = {k: audit.FILTERS[k] for k in letters[:-1]}
    out = audit.orders(audit.cells(df, spark.createDataFrame(MARKS, LABELS), own), letters)
    full = brute(ROWS, MARKS)
    for (part, order, step), row in got(out).items():
        want = next(v for (p, o, s), v in full.items() if p == part and o.startswith(order) and s == step)
        assert row[:3] == want[:3] and row[4:6] == want[4:6]
