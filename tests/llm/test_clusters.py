import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import clusters

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=40, rounds=5, dims=64):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in starts[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        of = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
        if step < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
                if mine:
                    centroids[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, o, far(v, centroids[o])) for (i, v), o in zip(kept, of, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, o, d, sum(e for _, p, e in out if p == o), sum(e for *_, e in out), sha[o]) for i, o, d in out), key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("x", "cluster", "was", "distance", "order")})
    out, centroids = clusters.cluster(df.repartition(3), **kw)
    done = clusters.with_inertia(out, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "measured").collect()
    return sorted((tuple(r)[:6] for r in done), key=str), sum(r["measured"] for r in done)


def blobs(n, dims, spread=0.05, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dims))
    return [(i, [float(x) for x in middle[i % 12] + spread * rng.normal(size=dims)]) for i in range(n)]


def test_against_brute_force(spark):
    rows = blobs(700, 64)
    got, measured = found(spark, rows)
    assert got == brute(rows)
    assert measured < 0.6 * 700 * 240  # six assignments to 40 centroids


@pytest.mark.parametrize("scale_up", [1, 5000, 300_000])
def test_ties_and_large_components(spark, scale_up):
    """On a grid most distances tie; beyond what doubles hold exactly, whole numbers are used."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) * scale_up for x in rng.integers(0, 2, 4)]) for i in range(300)]
    assert found(spark, rows, k=7, dims=4)[0] == brute(rows, 7, dims=4)


def test_odd_rows(spark):
    ok = blobs(30, 4)
    odd = [(100, None), (101, []), (102, [1.0] * 3), (103, [1.0, None, 2.0, 3.0]), (104, [float("nan")] * 4), (105, [1.0, 2.0, float("-inf"), 0.0]), (None, [0.5] * 4), (3, [0.25, -0.75, 0.1, 9.0]), *ok[5:9]]
    assert found(spark, ok + odd, k=6, dims=4)[0] == brute(ok + odd, 6, dims=4)
    assert found(spark, ok[:3], k=6, dims=4)[0] == brute(ok[:3], 6, dims=4)
    assert found(spark, [(None, [0.5] * 4)], dims=4)[0] == []
    assert found(spark, [], dims=4)[0] == []


def test_too_large_for_a_long(spark):
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(1, [1e9] * 4), (2, [0.0] * 4)], dims=4)


def test_tables_of_earlier_rounds_are_deleted(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.glob("quillmark-clusters-*"))
    clusters.cluster(spark.createDataFrame(blobs(200, 4), SCHEMA), k=9, dims=4)
    assert len(set(folder.glob("quillmark-clusters-*")) - before) == 1
