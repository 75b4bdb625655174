import random
import statistics

import pytest

from pyspark.sql import functions as F

from quillmark.operators import profile, sampling
from quillmark.operators.profile import DatasetSpec
from quillmark.sources import datasets

SPEC = DatasetSpec("people.CSV", order=("k",))


def rows(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, 10.0, "a", " x"), (2, 20.0, "a", "y"), (3, None, "b", "n/a"), (4, 40.0, None, "5"), (5, 20.0, "b", "2024-01-01")]
    return spark.createDataFrame(data, "k long, n double, c string, m string")


def test_dataset_profile(people):
    r = profile.dataset_profile(people, SPEC).first()
    assert (r["rows"], r["cols"], r["file_size_estimate"], r["duplicate_rows"], r["empty_rows"], r["empty_cols"], r["constant_cols"], r["format"]) == (5, 4, 160, 0, 0, 0, [], "csv")
    assert r["column_count_by_type"] == {"numeric": 2, "categorical": 2}


def test_duplicates_and_empty_rows(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "-"), ("a", "b")], "x string, y string")
    r = profile.dataset_profile(df, DatasetSpec("t.csv")).first()
    assert (r["duplicate_rows"], r["duplicate_pct"], r["empty_rows"], r["constant_cols"]) == (1, 25.0, 1, ["x", "y"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "x string, n double")
    r = profile.dataset_profile(df, DatasetSpec("t.csv")).first()
    assert (r["rows"], r["empty_cols"], r["duplicate_pct"]) == (0, 2, 0.0)
    assert profile.numeric_profile(df, DatasetSpec("t.csv")).first()["mean"] is None


def test_index_quantiles(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)], "k long, x double")
    r = profile.numeric_profile(df, SPEC, ["x"]).first()
    assert (r["q1"], r["q3"], r["median"], r["mode"], r["iqr"]) == (2.0, 4.0, 2.5, 1.0, 2.0)


def test_one_value_has_no_spread(spark):
    r = profile.numeric_profile(spark.createDataFrame([(7.0,)], "x double"), SPEC, ["x"]).first()
    assert (r["variance"], r["std"], r["skewness"], r["kurtosis"]) == (0.0, 0.0, 0.0, 0.0)


def test_numeric_profile_against_python(spark):
    rnd = random.Random(3)
    values = [round(rnd.gauss(5, 2), 1) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = profile.numeric_profile(df, SPEC, ["x"]).first()
    ordered, n, mean, s = sorted(values), len(values), statistics.fmean(values), statistics.stdev(values)
    assert (r["q1"], r["q3"]) == (ordered[n // 4], ordered[n * 3 // 4])
    assert r["median"] == pytest.approx(statistics.median(values), abs=1e-3)
    assert r["mode"] == min(statistics.multimode(values))
    assert r["skewness"] == pytest.approx(sum(((v - mean) / s) ** 3 for v in values) / n, abs=2e-3)
    assert r["kurtosis"] == pytest.approx(sum(((v - mean) / s) ** 4 for v in values) / n - 3, abs=2e-3)


def test_brackets_narrow_again(spark, monkeypatch):
    monkeypatch.setattr(profile, "BRACKET_VALUES", 3)
    df = spark.range(500).selectExpr("cast(id as double) as x")
    assert profile.values_at(df, {"x": [0, 250, 499]}) == {"x": {0: 0.0, 250: 250.0, 499: 499.0}}


def test_text_column_of_numbers(spark):
    df = spark.createDataFrame([("1",), (" 3 ",), ("x",), ("n/a",)], "x string")
    r = profile.numeric_profile(df, DatasetSpec("t.csv", {"x": "numeric"})).first()
    assert (r["n"], r["mean"]) == (2, 2.0)


def test_top_values_tie_by_first_row(people):
    top = [(r["value"], r["count"], r["pct"]) for r in profile.top_values(people, SPEC, ["c"]).orderBy("rank").collect()]
    assert top == [("a", 2, 50.0), ("b", 2, 50.0)]
    r = profile.categorical_profile(people, SPEC, ["c"]).first()
    assert (r["entropy"], r["mode"]) == (1.0, "a")


def test_missing(people):
    found = rows(profile.missing_profile(people), "column")
    assert (found["n"]["missing"], found["n"]["missing_pct"], found["n"]["high"], found["k"]["missing"]) == (1, 20.0, False, 0)
    assert profile.missing_per_row(people).first()["max_missing_per_row"] == 2


def test_missing_together(spark):
    df = spark.createDataFrame([(None, None), (None, None), ("a", None), ("a", "b")], "x string, y string")
    r = profile.missing_together(df).first()
    assert (r["a"], r["b"], r["coefficient"]) == ("x", "y", 0.82)


def test_quality(people):
    found = rows(profile.quality_profile(people, DatasetSpec("p.csv", {"m": "numeric"})), "column")
    assert (found["m"]["whitespace"], found["m"]["mixed_types"], found["m"]["invalid"]) == (True, True, 3)
    assert not found["c"]["mixed_types"]


def test_keys(spark):
    df = spark.createDataFrame([(k, k // 2, k % 2, k) for k in range(20)], "a long, b long, c long, d long")
    keys = rows(profile.key_profile(df, SPEC), "column")
    assert keys["a"]["candidate_key"] and not keys["b"]["candidate_key"] and not keys["b"]["high_cardinality"]
    assert profile.composite_keys(df, DatasetSpec("t.csv", order=("a",))) == [("a", "d")]


def test_selection_policy():
    assert [sampling.selection(n) for n in (1000, 1001, 5000, 5001)] == [("exact", 1000), ("representative", 500), ("representative", 900), ("representative", 200)]
    assert sampling.sample_metadata(200)["coverage"] == "exact" and sampling.sample_metadata(201)["coverage"] == "sample"


def test_positions_and_samples(spark):
    df = spark.range(1000).selectExpr("999 - id as k", "cast(id % 7 as string) as c", "cast(id as double) as v")
    placed = sampling.with_position(df, ["k"])
    assert placed.filter("_pos <> k").count() == 0
    picked = sampling.sample_positions(placed, "_pos", 1000, 100, sampling.seed_of("d", "h"), "v", "c")
    assert len(picked) == len(set(picked)) == 100 and set(range(15)) <= set(picked) and set(range(985, 1000)) <= set(picked)
    assert picked == sampling.sample_positions(placed, "_pos", 1000, 100, sampling.seed_of("d", "h"), "v", "c")
    assert sampling.rows_at(placed, "_pos", picked).count() == 100


def test_profile_runs(people):
    state = datasets.profile_all(people, SPEC)
    assert set(state.status.values()) == {"done"} and state.run == 1
    assert datasets.profile_all(people, SPEC, state).run == 1
    assert not state.publish(0, "dataset", None)
    assert datasets.fingerprint(people, SPEC).endswith("_5_4")


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    df, spec = datasets.read(spark, str(tmp_path / "t.csv"))
    assert df.collect()[0]["b"] == "x" and spec.format == "csv"
    assert datasets.header_profile(df, spec) == [("a", "categorical"), ("b", "categorical")]
    df.write.json(str(tmp_path / "t.json"))
    assert datasets.read(spark, str(tmp_path / "t.json"))[0].count() == 1


def test_empty_tables_have_a_row_for_each_column(spark):
    df, spec = spark.createDataFrame([], "x string, n double"), DatasetSpec("t.csv")
    for made in (profile.column_counts(df, df.columns), profile.missing_profile(df), profile.key_profile(df, spec), profile.quality_profile(df, spec)):
        assert {r["column"] for r in made.collect()} == {"x", "n"}
    assert profile.column_counts(df, df.columns).first()["rows"] == 0
    assert [(r["missing"], r["missing_pct"], r["high"]) for r in profile.missing_profile(df).collect()] == [(0, 0.0, False)] * 2
    assert not any(r["candidate_key"] or r["unique_col"] or r["high_cardinality"] for r in profile.key_profile(df, spec).collect())
    assert tuple(profile.missing_per_row(df).first()) == (0.0, 0)
    assert profile.categorical_profile(df, spec, ["x"]).count() == profile.top_values(df, spec, ["x"]).count() == 0
    assert profile.composite_keys(df, spec) == [] and profile.missing_together(df).count() == 0
    assert profile.numeric_profile(df, spec).select("column", "n", "q1", "mode").collect() == [("n", 0, None, None)]


def test_narrowing_ends_on_equal_and_odd_values(spark, monkeypatch):
    monkeypatch.setattr(profile, "BRACKET_VALUES", 2)
    rnd = random.Random(8)
    lists = [[5.0] * 400, [0.0] * 300 + [1.0] * 300, sorted(rnd.choice([-1e300, 0.0, 1e-300, 3.5, 1e300]) for _ in range(500)), sorted(rnd.gauss(0, 1) for _ in range(900))]
    for values in lists:
        df = spark.createDataFrame([(v, None if k % 3 else v) for k, v in enumerate(values)], "x double, y double")
        ranks = [0, 1, len(values) // 4, len(values) // 2, len(values) - 1]
        kept = [v for k, v in enumerate(values) if k % 3 == 0]
        got = profile.values_at(df, {"x": ranks, "y": [0, len(kept) // 2]})
        assert got == {"x": {r: sorted(values)[r] for r in ranks}, "y": {0: min(kept), len(kept) // 2: sorted(kept)[len(kept) // 2]}}


def test_a_profile_after_an_append_reads_the_new_rows_only(spark):
    import random

    rng = random.Random(9)
    old = [(rng.choice([None, 1.5, -3.0, rng.gauss(0, 9), float("nan"), float("inf")]), k % 7) for k in range(900)]
    new = [(rng.gauss(5, 1), 7) for _ in range(300)] + [(None, None)]
    frame = lambda rows: spark.createDataFrame(rows, "x double, y int").repartition(3)
    kept = profile.numeric_counts(frame(old), SPEC, ["x", "y"]).checkpoint()
    merged = profile.merged_counts(kept, profile.numeric_counts(frame(new), SPEC, ["x", "y"]))
    after = sorted(profile.profile_of_counts(merged, ["x", "y", "none"]).collect())
    whole = sorted(profile.numeric_profile(frame(old + new).withColumn("none", F.lit(None).cast("double")), SPEC, ["x", "y", "none"]).collect())
    assert after == whole and [r["n"] for r in after if r["column"] == "none"] == [0]


def test_numeric_profile_reads_the_table_once_and_holds_no_column_in_a_task(spark):
    df = spark.range(1000).selectExpr("cast(id % 97 AS double) AS x")
    plan = profile.profile_of_counts(profile.numeric_counts(df, SPEC, ["x"]), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "Range (0" not in plan and "SinglePartition" not in plan
