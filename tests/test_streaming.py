from pyspark.sql import functions as F

from quillmark.operators import prompt
from quillmark.streaming.replies import cached_replies

SCHEMA = "query_id string, workspace string, model string, query string, reply string, s long, vector array<double>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed(spark, tmp_path, batches, **kw):
    """Rows of each batch as one micro-batch, in order; what the stream answers."""
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1)
        df.write.mode("append").parquet(str(source / f"b={k}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = spark.readStream.schema("query_id string, workspace string, model string, query string, reply string, vector array<double>, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(source / "b=*"))
        name = f"replies_{abs(hash(str(tmp_path)))}"
        query = cached_replies(stream, **kw).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        return sorted(tuple(r) for r in spark.table(name).collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_replayed_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    """Keys set again within and after their time, similar ones, and other workspaces."""
    unit = lambda k: [1.0 if j == k % 6 else 0.01 * (k % 3) for j in range(6)]
    puts = [(f"p{k}", "w" if k % 5 else "v", "m", f"Query  {k % 9}", f"reply {k}", 10 * k, unit(k % 9)) for k in range(45)]
    asks = [(f"a{k}", "w" if k % 4 else "v", "m", f"query {k}", None, 460, unit(k)) for k in range(12)]
    got = replayed(spark, tmp_path, [puts[:20], puts[20:], asks], most=20, ttl=120)
    want = []
    for w in ("w", "v"):
        own = spark.createDataFrame([p for p in puts if p[1] == w], SCHEMA).withColumn("at", F.timestamp_seconds("s"))
        live = prompt.live(own.select("workspace", "model", "query", "reply", "at", "vector"), F.timestamp_seconds(F.lit(460)), 120, 20).checkpoint()
        asked = spark.createDataFrame([a for a in asks if a[1] == w], SCHEMA).drop("reply", "s")
        exact = prompt.exact_hits(asked, live)
        near = prompt.similar_hits(asked.join(exact, "query_id", "left_anti"), live).select("query_id", "reply")
        want += [(r["query_id"], r["reply"], "exact") for r in exact.collect()] + [(r["query_id"], r["reply"], "similar") for r in near.collect()]
    assert got == sorted(want) and {x[2] for x in got} == {"exact", "similar"}


def test_entries_end_with_their_time_and_states_with_all(spark, tmp_path):
    put = lambda k, s: (f"p{k}", "w", "m", f"q{k}", f"reply {k}", s, None)
    ask = lambda k, s: (f"a{k}-{s}", "w", "m", f" Q{k} ", None, s, None)
    batches = [[put(1, 10), ask(1, 110)], [ask(1, 111), put(2, 500)], [ask(1, 502), ask(2, 600), ask(2, 601)]]
    assert [x[0] for x in replayed(spark, tmp_path, batches, ttl=100)] == ["a1-110", "a2-600"]


def test_what_was_put_first_goes_first(spark, tmp_path):
    """A key set again keeps its place, so it goes although its reply is newer; one set again after it went is new."""
    put = lambda k, s: (f"p{k}-{s}", "w", "m", f"q{k}", f"reply {k} of {s}", s, None)
    ask = lambda k, s: (f"a{k}-{s}", "w", "m", f"q{k}", None, s, None)
    batches = [[put(1, 1), put(2, 2), put(1, 3), ask(1, 4)], [put(3, 5), ask(1, 6), ask(2, 6), ask(3, 6)], [put(1, 7), ask(2, 8), ask(3, 8), ask(1, 8)]]
    assert replayed(spark, tmp_path, batches, most=2) == [("a1-4", "reply 1 of 3", "exact"), ("a1-8", "reply 1 of 7", "exact"), ("a2-6", "reply 2 of 2", "exact"), ("a3-6", "reply 3 of 5", "exact"), ("a3-8", "reply 3 of 5", "exact")]
