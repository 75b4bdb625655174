"""Notebook cells as a table: appending, status changes, reindexing, stale dependents, and a cell's context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.sources.shared import checkpointed

PRECEDING, HASH_CHARS, OUTPUT_CHARS, NONE = 5, 8, 180, "—"


def notebook_id(workspace: str) -> str:
    return f"nb_{workspace}"


def active(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("status") == "active")


def of_dataset(cells: DataFrame, dataset_id: str) -> DataFrame:
    return cells.filter(F.array_contains("dataset_ids", dataset_id))


def reindexed(cells: DataFrame) -> DataFrame:
    """idx is the place from one within each notebook."""
    return cells.withColumn("idx", F.row_number().over(Window.partitionBy("notebook_id").orderBy("idx", "id")))


def appended(cells: DataFrame, new: DataFrame) -> DataFrame:
    """New cells (without idx) after the last of their notebook, in order of their ids."""
    last = cells.groupBy("notebook_id").agg(F.max("idx").alias("_last"))
    place = F.row_number().over(Window.partitionBy("notebook_id").orderBy("id"))
    placed = new.join(last, "notebook_id", "left").withColumn("idx", (F.coalesce("_last", F.lit(0)) + place).cast(cells.schema["idx"].dataType)).drop("_last")
    return cells.unionByName(placed, allowMissingColumns=True)


def superseded_from(cells: DataFrame, notebook: str, index: int) -> DataFrame:
    hit = (F.col("notebook_id") == notebook) & (F.col("idx") >= index) & (F.col("status") == "active")
    return cells.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status")))


def updated(cells: DataFrame, patch: DataFrame) -> DataFrame:
    """Cells with the patch's columns (by id); a null in the patch keeps what was there."""
    columns = [c for c in patch.columns if c != "id"]
    both = cells.join(patch.select("id", *(F.col(c).alias(f"_{c}") for c in columns)), "id", "left")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in cells.columns))


def deleted(cells: DataFrame, ids: DataFrame) -> DataFrame:
    return reindexed(cells.join(ids.select("id"), "id", "left_anti"))


def stale_dependents(cells: DataFrame, changed: str) -> DataFrame:
    """id of the active cells that depend on the changed one, directly or not, by dependencies on earlier cells.

    Cells with one earlier dependency point to it and jump to where that points, so a chain takes rounds in the logarithm
    of its length.  Over the others, one frontier join a round until the frontier is empty.
    """
    edges = cells.select(F.col("id").alias("child"), "idx", F.explode("depends_on").alias("parent"))
    position = cells.select(F.col("id").alias("parent"), F.col("idx").alias("parent_idx"))
    forward = checkpointed(edges.join(position, "parent").filter("parent_idx < idx").select("parent", "child").distinct())
    single = forward.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("to")).filter((F.col("n") == 1) & (F.col("child") != changed))
    pointers = checkpointed(single.select(F.col("child").alias("id"), "to"))
    for _ in range(64):
        jumped = checkpointed(pointers.join(pointers.toDF("to", "beyond"), "to", "left").select("id", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
        pointers = jumped.select("id", "to")
        if jumped.filter("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("cells depend on each other in a circle")
    ends = pointers.select(F.col("id").alias("parent"), "to")
    joints = checkpointed(forward.join(pointers.select(F.col("id").alias("child")), "child", "left_anti").join(ends, "parent", "left").select("child", F.coalesce("to", "parent").alias("parent")))
    frontier = reached = cells.sparkSession.createDataFrame([(changed,)], "id string")
    while True:
        frontier = checkpointed(joints.join(frontier.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("child").alias("id")).distinct().join(reached, "id", "left_anti"))
        if frontier.limit(1).count() == 0:
            break
        reached = checkpointed(reached.unionByName(frontier))
    beyond = pointers.join(reached.withColumnRenamed("id", "to"), "to", "left_semi").select("id")
    return reached.unionByName(beyond).filter(F.col("id") != changed).join(active(cells).select("id"), "id", "left_semi")


def marked_stale(cells: DataFrame, changed: str) -> DataFrame:
    hit = stale_dependents(cells, changed).withColumn("_stale", F.lit(True))
    return cells.join(hit, "id", "left").withColumn("status", F.when(F.col("_stale"), "stale").otherwise(F.col("status"))).drop("_stale")


def preceding(cells: DataFrame, notebook: str, index: int, most: int = PRECEDING) -> DataFrame:
    """The last cells before an index that aren't superseded, in their order."""
    before = cells.filter((F.col("notebook_id") == notebook) & (F.col("idx") < index) & (F.col("status") != "superseded"))
    return before.orderBy(F.desc("idx"), "id").limit(most).orderBy("idx", "id")


def lineage(cells: DataFrame, cell_id: str) -> DataFrame:
    """The cell with those it names as sources or dependencies."""
    own = cells.filter(F.col("id") == cell_id)
    linked = own.select(F.explode(F.array_union(F.array("id"), F.array_union(F.coalesce("source_cell_ids", F.array().cast("array<string>")), F.coalesce("depends_on", F.array().cast("array<string>"))))).alias("id"))
    return cells.join(linked, "id", "left_semi")


def datasets_of(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode("dataset_ids").alias("dataset_id")).distinct()


def contexts(cells: DataFrame, asked: DataFrame, most: int = PRECEDING) -> DataFrame:
    """query_id, notebook_context of every asked cell (query_id, notebook_id, cell_id) that exists: itself, the cells before it, its lineage.

    cells: notebook_id, id, idx, type, status, title, operation, columns, dataset_ids, input_hash, output_hash, outputs
    (array of struct<type, title, data>), source_cell_ids, depends_on.  Cells that aren't superseded are numbered within
    their notebook, so those before an asked one are found by an equi-join on the numbers, at most `most` for each.
    """
    order = Window.partitionBy("notebook_id").orderBy("idx", "id")
    standing = F.col("status") != "superseded"
    numbered = cells.withColumn("_before", F.coalesce(F.count(F.when(standing, 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = asked.select("query_id", "notebook_id", F.col("cell_id").alias("id")).join(numbered, ["notebook_id", "id"])
    title, text = F.coalesce("title", F.lit("")), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    listed = lambda c: F.coalesce(F.when(F.size(c) > 0, F.array_join(c, ", ")), F.lit(NONE))

    names = numbered.filter(standing).select("notebook_id", (F.col("_before") + 1).alias("_number"), text("Cell ", F.col("idx").cast("string"), " ", F.col("type"), " ", title).alias("line"))
    wanted = own.select("query_id", "notebook_id", F.explode(F.filter(F.sequence(F.col("_before") - (most - 1), F.col("_before")), lambda n: n > 0)).alias("_number"))
    in_order = lambda by, line, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, line))), lambda s: s[line]), sep)
    before = wanted.join(names, ["notebook_id", "_number"]).groupBy("query_id").agg(in_order("_number", "line", " | ").alias("_preceding"))

    none = F.array().cast("array<string>")
    links = own.select("query_id", "notebook_id", F.explode(F.array_union(F.array("id"), F.array_union(F.coalesce("source_cell_ids", none), F.coalesce("depends_on", none)))).alias("id"))
    line = links.join(cells.select("notebook_id", "id", "idx"), ["notebook_id", "id"]).groupBy("query_id").agg(F.count("*").alias("_linked"), in_order("idx", "id", ", ").alias("_lineage"))

    short = lambda c: F.substring(F.col(c), 1, HASH_CHARS)
    shown = F.transform("outputs", lambda o: text(o["type"], ":", F.coalesce(o["title"], F.lit("")), " ", F.substring(F.coalesce(o["data"], F.lit("")), 1, OUTPUT_CHARS)))
    lines = (
        text("Active Cell ", F.col("idx").cast("string"), " [", F.col("type"), "] status=", F.col("status"), ' title="', title, '"'),
        text("Operation: ", F.coalesce("operation", F.lit(NONE)), " columns: ", F.coalesce(F.array_join("columns", ", "), F.lit(NONE))),
        text("Datasets: ", listed("dataset_ids")),
        text("Execution: inputHash=", F.coalesce(short("input_hash"), F.lit("")), " outputHash=", F.coalesce(short("output_hash"), F.lit(NONE))),
        text("Outputs: ", F.coalesce(F.array_join(shown, " | "), F.lit(""))),
        text("Preceding: ", F.col("_preceding")),
        F.when(F.col("_linked") > 1, text("Lineage: ", F.col("_lineage"))),
    )
    return own.join(before, "query_id", "left").join(line, "query_id", "left").select("query_id", F.concat_ws("\n", *lines).alias("notebook_context"))
