import pytest
from pyspark.sql import functions as F

from quillmark.functions.vectors import hashed_words
from quillmark.operators import knowledge, notebook, prompt
from quillmark.sources import ipynb, stores

OUTPUT = "struct<id:string,type:string,title:string,row_count:bigint,columns:array<string>,chart_type:string,data:string>"
CELL = f"notebook_id string, id string, idx int, type string, status string, dataset_ids array<string>, operation string, columns array<string>, markdown string, source_cell_ids array<string>, depends_on array<string>, outputs array<{OUTPUT}>, created_at timestamp"


def cell(i, kind, depends=(), status="active", operation=None, columns=None, outputs=(), datasets=("d1",)):
    return ("nb", f"c{i}", i, kind, status, list(datasets), operation, columns, None, [], list(depends), list(outputs), None)


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(
        [
            cell(1, "upload", outputs=[("o1", "dataset", "sales", 10, None, None, None)]),
            cell(2, "clean", ["c1"], operation="fill", columns=["price"], outputs=[("o2", "diff", None, None, None, None, '{"rowsRemoved": 3, "valuesChanged": 2}')]),
            cell(3, "analysis", ["c2"], operation="mean", columns=["price"], outputs=[("o3", "metric", None, None, None, None, '{"mean": 4}'), ("o9", "mystery", None, None, None, None, "x")]),
            cell(4, "visualization", ["c3"], operation="histogram", columns=["price"], outputs=[("o4", "chart", "prices", None, ["price"], "bar", None)]),
            cell(5, "export", ["c1"], outputs=[("o5", "file", None, None, None, None, '{"fileName": "out.csv"}')]),
        ],
        CELL,
    )


@pytest.fixture(scope="module")
def made(spark, cells):
    notebooks = spark.createDataFrame([("nb", "w")], "id string, workspace_id string")
    return {r["id"]: r for r in knowledge.notebook_records(notebooks, cells).collect()}


def test_narratives(made):
    assert made["c1::narrative"]["text"] == "Cell 1 [upload] loaded dataset d1."
    assert made["c2::narrative"]["text"] == "Cell 2 [clean] operation fill columns price on dataset d1."
    assert made["c2::output:o2"]["text"] == "Cell 2 diff: 3 rows removed, 2 values changed."
    assert made["c1::output:o1"]["text"] == 'Cell 1 dataset "sales": 10 rows.'
    assert made["c4::output:o4"]["text"] == 'Cell 4 chart "prices" type bar for price.' and made["c4::output:o4"]["kind"] == "notebook_visualization"
    assert made["c5::output:o5"]["text"] == "Cell 5 file: out.csv"
    assert made["c2::col:price"]["text"] == 'Cell 2 fill affected column "price" on dataset d1.'
    assert made["nb::summary"]["text"] == "Workspace w notebook contains 5 cells, datasets: d1."
    assert "c3::output:o9" not in made and "c3::col:price" not in made


def test_stale_dependents(spark, cells):
    assert {r["id"] for r in notebook.stale_dependents(cells, "c2").collect()} == {"c3", "c4"}
    assert {r["id"]: r["status"] for r in notebook.marked_stale(cells, "c3").collect()}["c4"] == "stale"


def test_mutations(spark, cells):
    new = cells.filter("id = 'c5'").withColumn("id", F.lit("c6")).drop("idx")
    assert notebook.appended(cells, new).filter("id = 'c6'").first()["idx"] == 6
    assert notebook.superseded_from(cells, "nb", 4).filter("status = 'superseded'").count() == 2
    gone = notebook.deleted(cells, spark.createDataFrame([("c2",)], "id string"))
    assert [(r["id"], r["idx"]) for r in gone.orderBy("idx").collect()] == [("c1", 1), ("c3", 2), ("c4", 3), ("c5", 4)]
    patch = spark.createDataFrame([("c1", "stale")], "id string, status string")
    assert notebook.updated(cells, patch).filter("status = 'stale'").first()["id"] == "c1"


def test_context(cells):
    assert [r["id"] for r in notebook.preceding(cells, "nb", 5, 2).collect()] == ["c3", "c4"]
    assert {r["id"] for r in notebook.lineage(cells, "c3").collect()} == {"c2", "c3"}
    assert [r[0] for r in notebook.datasets_of(cells).collect()] == ["d1"]
    assert notebook.of_dataset(notebook.active(cells), "d2").count() == 0


def test_kinds(spark):
    df = spark.createDataFrame([("note",), ("visualization",), ("what",), (None,)], "kind string")
    assert [r[0] for r in df.select(knowledge.normalized_kind(F.col("kind"))).collect()] == ["note", "notebook_visualization", "notebook_output", "notebook_output"]


def test_normalised_records(spark):
    df = spark.createDataFrame([("x", "d1")], "id string, d string")
    made = knowledge.records(df, id=F.col("id"), kind="cell", text=F.col("id"), workspace=F.lit("w"), dataset=F.col("d"), metadata={"column": F.lit("c")}, provenance={})
    r = knowledge.normalized(made).first()
    assert (r["kind"], r["provenance"]["dataset_ids"], r["provenance"]["columns"]) == ("notebook_cell", ["d1"], ["c"])


def test_catalogues(spark):
    both = knowledge.catalogue(spark, "w", "note", "dict::", knowledge.DICTIONARY).unionByName(knowledge.catalogue(spark, "w", "functionality", "func::", knowledge.FUNCTIONALITIES))
    assert both.select("id").distinct().count() == len(knowledge.DICTIONARY) + len(knowledge.FUNCTIONALITIES)


def test_fallback_text():
    assert knowledge.fallback_text("f", "d", [("a", "numeric", None), ("b", "categorical", ["x", "y", "z", "w"])]) == "Representative sample for f (d): a(numeric) top n/a | b(categorical) top x, y, z"


def test_store(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"), "id string, v int")
    assert store.read().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v int")
    store.put(rows(("a", 1), ("b", 1)))
    store.put(rows(("a", 2), ("a", 3)), ["v"])
    assert {(r["id"], r["v"]) for r in store.read().collect()} == {("a", 3), ("b", 1)}
    assert store.get(F.col("id") == "b").count() == 1
    assert store.delete(F.col("id") == "b").count() == 1
    assert store.clear().count() == 0


def test_embedding_cache(spark):
    calls = []

    def embedder(texts):
        calls.extend(texts)
        return hashed_words(8)(texts)

    now = F.timestamp_seconds(F.lit(10))
    cache = spark.createDataFrame([], stores.CACHE_SCHEMA)
    texts = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    known, cache = stores.through_cache(cache, texts, "m", hashed_words(8), now)
    assert known.count() == 2 and cache.count() == 2
    again, kept = stores.through_cache(cache.checkpoint(), texts, "m", hashed_words(8), F.timestamp_seconds(F.lit(20)))
    assert again.count() == 2 and kept.count() == 2
    assert {r["used_at"].timestamp() for r in kept.collect()} == {20.0}
    other, more = stores.through_cache(cache, texts, "other", hashed_words(8), now)
    assert more.count() == 4


def test_trims(spark):
    df = spark.createDataFrame([(k, "u", [1.0]) for k in range(10)], "k int, owner string, v array<float>")
    assert {r["k"] for r in stores.trimmed_by_count(df, "k", "k", 3).collect()} == {7, 8, 9}
    size = stores.entry_bytes(F.col("v"))
    assert stores.trimmed_by_bytes(df, size, "k", "k", 100, 10_000).count() == 10
    assert {r["k"] for r in stores.trimmed_by_bytes(df, size, "k", "k", 5, 10_000, owner="owner").collect()} == {6, 7, 8, 9}


def test_notebook_documents(spark, cells, tmp_path):
    notebooks = spark.createDataFrame([("nb", "w")], "id string, workspace_id string")
    source = cells.select("notebook_id", "id", "idx", "type", "status", F.concat(F.lit("run "), "id").alias("source"), F.transform("outputs", lambda o: F.struct(o["type"].alias("type"), F.repeat(F.lit("x"), 3000).alias("data"))).alias("outputs"))
    documents = ipynb.exported(notebooks, source)
    assert len(documents.first()["document"]) < 5 * 2 * 2000 + 4000
    back = {r["id"]: (r["idx"], r["type"], r["source"]) for r in ipynb.imported(documents).collect()}
    assert back["c2"] == (2, "clean", "run c2") and back["c4"] == (4, "transform", "run c4")
    path = str(tmp_path / "docs")
    ipynb.write_notebooks(documents, path)
    assert ipynb.read_notebooks(spark, path, "notebook_id string, document string").count() == 1
    assert ipynb.read_notebooks(spark, path + "-none", "notebook_id string").count() == 0


@pytest.mark.parametrize(("n", "limit", "head", "want"), [(30, 20, 1, [0, *range(11, 30)]), (10, 4, 2, [0, 1, 8, 9]), (5, 0, 1, []), (5, -1, 1, [0, 1, 2, 3, 4]), (3, 20, 1, [0, 1, 2])])
def test_history_window(spark, n, limit, head, want):
    df = spark.createDataFrame([(1, k, "user", f"m{k}") for k in range(n)], "conv_id int, turn int, role string, text string")
    assert sorted(r["turn"] for r in prompt.history_window(df, limit=limit, head=head).collect()) == want


def test_prompt(spark, made):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", " "), (1, 2, "assistant", "hello")], "conv_id int, turn int, role string, text string")
    assert prompt.folded(df).first()["history"] == "User: hi\n\nAssistant: hello"
    lines = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id int, place int, line string")
    assert prompt.assembled("head", lines).first()["prompt"] == "head\n\na\nb"


def test_reply_cache(spark):
    entries = spark.createDataFrame([("w", "m", "What  is X", "old", 1, [1.0, 0.0]), ("w", "m", "what is x", "new", 100, [1.0, 0.0]), ("v", "m", "other", "r", 100, [1.0, 0.01])], "workspace string, model string, query string, reply string, s long, vector array<float>").withColumn("at", F.timestamp_seconds("s")).drop("s")
    at = lambda s: prompt.live(entries, F.timestamp_seconds(F.lit(s)))
    asked = spark.createDataFrame([(1, "w", "m", " WHAT is x ", [1.0, 0.1])], "query_id int, workspace string, model string, query string, vector array<float>")
    assert [r["reply"] for r in prompt.exact_hits(asked, at(400)).collect()] == ["new"]
    assert prompt.exact_hits(asked, at(401)).count() == 0
    assert [r["reply"] for r in prompt.similar_hits(asked, at(200)).collect()] == ["new"]


def test_streaming_upserts(spark, tmp_path):
    from quillmark.streaming import tables

    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "id string, v int, n int").write.parquet(source)
    store = stores.Store(spark, str(tmp_path / "store"), "id string, v int, n int")
    stream = spark.readStream.schema("id string, v int, n int").parquet(source)
    query = tables.upserts(stream, store, ["n"], str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["id"], r["v"]) for r in store.read().collect()} == {("a", 2), ("b", 1)}


def test_streaming_deduplication(spark, tmp_path):
    from quillmark.streaming import tables

    source = str(tmp_path / "in")
    spark.createDataFrame([("k", 1), ("k", 2), ("j", 3)], "key string, s long").withColumn("at", F.timestamp_seconds("s")).write.parquet(source)
    stream = spark.readStream.schema("key string, s long, at timestamp").parquet(source)
    query = tables.first_replies(stream, "at").writeStream.format("memory").queryName("replies").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("replies").count() == 2


def test_stale_dependents_of_long_chains(spark):
    """Two chains of 1,100 cells that meet in one, and a chain behind it; a cell before the changed one stays."""
    rows = [("x", 0, "active", [])] + [(f"{c}{k}", k, "active", [f"{c}{k - 1}"] if k > 1 else ["x"]) for c in "ab" for k in range(1, 1101)]
    rows += [("m", 1101, "active", ["a1100", "b1100"])] + [(f"z{k}", 1102 + k, "superseded" if k == 5 else "active", [f"z{k - 1}"] if k else ["m"]) for k in range(20)]
    cells = spark.createDataFrame(rows, "id string, idx int, status string, depends_on array<string>")
    got = [r["id"] for r in notebook.stale_dependents(cells, "a1").collect()]
    assert sorted(got) == sorted([f"a{k}" for k in range(2, 1101)] + ["m"] + [f"z{k}" for k in range(20) if k != 5])


def test_notebook_store(spark, tmp_path):
    from quillmark.sources.stores import NotebookStore

    store, now = NotebookStore(spark, str(tmp_path / "notebooks")), F.timestamp_seconds(F.lit(50))
    rows = [("n1", "w1", "One", '[{"id": "c"}]', 1), ("n2", "w2", "Two", "[]", 2), ("n3", "w2", None, None, 3)]
    made = lambda rows: spark.createDataFrame(rows, "id string, workspace_id string, title string, cells string, at long").withColumn("created_at", F.timestamp_seconds("at")).withColumn("extra", F.lit(1))
    assert store.get("n1").count() == 0 and store.of_workspace("w1").count() == 0
    store.put(made(rows), now)
    assert store.get("n1").first()["cells"] == '[{"id": "c"}]' and store.get("n1").select(F.unix_timestamp("updated_at")).first()[0] == 50
    assert [r["id"] for r in store.of_workspace("w2").collect()] == [r["id"] for r in store.listed("w2").collect()] == ["n2"]
    store.put(made([("n2", "w2", "New", "[1]", 9), ("n2", "w2", "Old", "[2]", 8)]), now)
    assert store.get("n2").first()["title"] == "New" and store.listed("w1").count() == 1
    store.delete("n2")
    assert store.get("n2").count() == 0 and store.of_workspace("w2").first()["id"] == "n3"
    store.clear()
    assert store.listed("w1").count() == 0 and store.get(None).count() == 0


def test_contexts_of_odd_cells(spark):
    """Cells without anything, notebooks that don't exist, and several questions on one cell."""
    cells = spark.createDataFrame(
        [("n", f"c{k}", k, "clean", "superseded" if k == 3 else "active", None if k == 1 else f"t{k}", None, None, None, None, None, None, None, ["c2"] if k == 9 else None) for k in range(1, 10)],
        "notebook_id string, id string, idx int, type string, status string, title string, operation string, columns array<string>, dataset_ids array<string>, input_hash string, output_hash string, outputs array<struct<type:string,title:string,data:string>>, source_cell_ids array<string>, depends_on array<string>",
    )
    asked = spark.createDataFrame([("q1", "n", "c1"), ("q4", "n", "c4"), ("q9", "n", "c9"), ("r9", "n", "c9"), ("x", "other", "c9")], "query_id string, notebook_id string, cell_id string")
    got = {r["query_id"]: r["notebook_context"].split("\n") for r in notebook.contexts(cells, asked).collect()}
    assert set(got) == {"q1", "q4", "q9", "r9"} and got["q9"] == got["r9"]
    assert got["q1"] == ['Active Cell 1 [clean] status=active title=""', "Operation: — columns: —", "Datasets: —", "Execution: inputHash= outputHash=—", "Outputs: "]
    assert got["q4"][5:] == ["Preceding: Cell 1 clean  | Cell 2 clean t2"]
    assert got["q9"][5:] == ["Preceding: " + " | ".join(f"Cell {k} clean t{k}" for k in range(4, 9)), "Lineage: c2, c9"]


def test_documents_of_others(spark):
    """Sources as lists or texts, outputs of any kind, cells without metadata."""
    text = '{"metadata":{},"cells":[{"cell_type":"code","source":["# One\\n","x = [1]"],"outputs":[{"output_type":"stream","text":["a","b"]},{"output_type":"error","evalue":"e"}],"execution_count":7,"metadata":{}},{"cell_type":"markdown","source":"[1, 2]","metadata":{}}]}'
    one, two = ipynb.imported(spark.createDataFrame([(text,)], "document string")).orderBy("idx").collect()
    assert (one["type"], one["source"], one["title"], one["execution_count"]) == ("transform", "# One\nx = [1]", "One", 7)
    assert [tuple(o) for o in one["outputs"]] == [("text", "ab"), ("error", "")]
    assert (two["type"], two["source"], two["id"], two["outputs"]) == ("markdown", "[1, 2]", "cell-1", [])


def test_whole_sample_against_brute_force(spark):
    """The rows of sample_lcg, in their order, picked by hand: ends, quantiles, rare values, generator."""
    import hashlib

    import duckdb

    from quillmark.plans import records as plans

    sf = "/root/testdata/sf0.001"
    rows = duckdb.connect().execute(f"SELECT o_orderkey, o_totalprice, o_orderpriority FROM read_parquet('{sf}/orders.parquet') ORDER BY o_orderkey").fetchall()
    n, want = len(rows), 200
    picked = [*range(15), *range(n - 15, n)]
    by_price = sorted(range(n), key=lambda k: (rows[k][1], k))
    priorities = [r[2] for r in rows]
    rare = [priorities.index(v) for v in sorted(set(priorities), key=lambda v: (priorities.count(v), priorities.index(v)))[:5]]
    for k in [*by_price[:: max(1, n // (want - len(picked)))], *rare]:
        if k not in picked and len(picked) < want:
            picked.append(k)
    state = 0
    for ch in hashlib.sha256(b"orders:c:sample-v1:v1").hexdigest():
        state = (state * 33 % 2**32) ^ ord(ch)
    while len(picked) < want:
        state = (1664525 * state + 1013904223) % 2**32
        if state % n not in picked:
            picked.append(state % n)
    got = plans.sample_lcg(spark, sf).orderBy("place").collect()
    assert [(r["_pos"], r["o_orderkey"]) for r in got] == [(k, rows[k][0]) for k in picked]


def _ids(df):
    return {(r["id"], r["v"]) for r in df.collect()}


def test_a_put_rewrites_the_parts_of_its_keys(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"), "id string, v int", parts=8)
    store.put(spark.range(200).selectExpr("cast(id AS string) AS id", "cast(id AS int) AS v"))
    before = store.manifest()
    assert len(before.places) == 8
    store.put(spark.createDataFrame([("7", 70)], "id string, v int"))
    after = store.manifest()
    assert sum(before.places[k] != after.places[k] for k in before.places) == 1
    store.delete(F.col("id").isin("8", "9", "none"))
    assert 1 <= sum(store.manifest().places[k] != after.places[k] for k in before.places) <= 2
    last = store.manifest()
    store.delete(F.col("id") == "none")
    assert store.manifest() == last
    assert _ids(store.read()) == {(str(k), 70 if k == 7 else k) for k in range(200) if k not in (8, 9)}
    assert _ids(store.of_keys(spark.createDataFrame([("7",), ("8",), ("7",)], "id string"))) == {("7", 70)}


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer that finds another's state before its own keeps that one's rows, whether they share parts or not."""
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v int")
    for parts in (1, 64):
        path = str(tmp_path / f"s{parts}")
        first, second = (stores.Store(spark, path, "id string, v int", parts=parts) for _ in range(2))
        first.put(rows(("a", 1), ("b", 1)))
        publish, calls, writes = stores.Store._publish, [], []

        def between(self, state, publish=publish, calls=calls, second=second):
            calls.append(state.number)
            if len(calls) == 1:
                second.put(rows(("b", 2), ("c", 2)))
            return publish(self, state)

        with monkeypatch.context() as m:
            m.setattr(stores.Store, "_publish", between)
            first.change(lambda _: rows(("a", 3)), lambda old: writes.append(1) or stores.upserted(old, rows(("a", 3)), "id"))
        assert _ids(first.read()) == _ids(second.read()) == {("a", 3), ("b", 2), ("c", 2)}
        assert len(writes) == (2 if parts == 1 else 1)


def test_old_files_go_and_frames_stay_good_for_some_changes(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"), "id string, v int", parts=2, keep=3)
    rows = lambda v: spark.createDataFrame([("a", v), ("b", v)], "id string, v int")
    store.put(rows(0))
    held = store.read()
    for v in range(1, 3):
        store.put(rows(v))
    assert _ids(held) == {("a", 0), ("b", 0)}
    for v in range(3, 9):
        store.put(rows(v))
    assert _ids(store.read()) == {("a", 8), ("b", 8)}
    folders = [p for p in (tmp_path / "s").iterdir() if p.name != "manifests"]
    assert len(folders) <= 3 and len(list((tmp_path / "s" / "manifests").glob("0*"))) == 3


def test_an_incomplete_state_of_a_dead_writer_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores.time, "sleep", lambda _: None)
    store = stores.Store(spark, str(tmp_path / "s"), "id string, v int", parts=2)
    store.put(spark.createDataFrame([("a", 1)], "id string, v int"))
    (tmp_path / "s" / "manifests" / "000000000002").write_text('{"parts": 2, "pla')
    assert _ids(store.read()) == {("a", 1)}
    store.put(spark.createDataFrame([("b", 2)], "id string, v int"))
    assert _ids(store.read()) == {("a", 1), ("b", 2)} and store.manifest().number == 3


def test_puts_of_repeated_keys_and_nothing(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"), "id string, v int")
    store.put(spark.createDataFrame([], "id string, v int"))
    store.put(spark.createDataFrame([("a", 1), ("a", 5), ("a", None), (None, 3)], "id string, v int"))
    assert ("a", 5) in _ids(store.read()) and len(_ids(store.read())) == 2
    assert _ids(store.retain(spark.createDataFrame([("a", 0)], "id string, v int"))) == {("a", 5)}
    assert _ids(store.write(spark.createDataFrame([("z", 9)], "id string, v int"))) == {("z", 9)}


def test_trims_by_bytes_of_one_owner_over_ranges(spark):
    rows = [(k, ["u", "v", None][k % 3] if k % 7 else "u", [0.5] * (k % 5)) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, owner string, v array<float>")
    size = stores.entry_bytes(F.col("v"))
    for owner in (None, "owner"):
        want = set()
        for o in {r[1] for r in rows} if owner else [None]:
            mine = sorted((r for r in rows if not owner or r[1] == o), reverse=True)
            sizes = [4 * len(r[2]) + 300 for r in mine]
            if len(mine) <= 150 and sum(sizes) <= 40_000:
                want |= {r[0] for r in mine}
            else:
                want |= {r[0] for n, r in enumerate(mine, 1) if n <= 120 and sum(sizes[:n]) <= 32_000}
        trimmed = stores.trimmed_by_bytes(df, size, "k", "k", 150, 40_000, owner=owner)
        assert {r["k"] for r in trimmed.collect()} == want and trimmed.columns == df.columns
        assert "SinglePartition" not in trimmed._jdf.queryExecution().executedPlan().toString()


def test_notebooks_are_exported_with_one_shuffle_of_their_cells(spark):
    from quillmark.sources import ipynb

    notebooks = spark.createDataFrame([("a", "w1"), ("b", "w2"), ("a", "w3")], "id string, workspace_id string")
    cells = spark.createDataFrame([("a", "2", 2, "clean", "active"), ("a", "1", 1, "clean", "active"), ("c", "9", 1, "clean", "active"), (None, "8", 1, "clean", "active")], "notebook_id string, id string, idx int, type string, status string")
    made = ipynb.exported(notebooks, cells)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    back = sorted((r["notebook_id"], r["workspace_id"], r["id"]) for r in ipynb.imported(made).collect())
    shown = ipynb.exported(notebooks, cells.withColumn("outputs", F.array(F.struct(F.lit("table").alias("type"), F.lit("ddd").alias("data"))))).filter("notebook_id = 'a'").first()["document"]
    assert '"outputs":[{"output_type":"display_data","data":{"text/plain":"ddd","application/json":"ddd"},"metadata":{}}]' in shown
    assert made.count() == 3 and back == [("a", "w1", "1"), ("a", "w1", "2"), ("a", "w3", "1"), ("a", "w3", "2")]
