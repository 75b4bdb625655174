"""Notebook documents: compressed JSON, and nbformat 4.5 in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_CHARS, ERROR_CHARS, TITLE_CHARS = 2000, 500, 80
#: Parts of an export for each shuffle partition of the session, so that a part's cells fit into the memory of a task.
PARTS = 4
#: Cell types that survive a round trip by name; other code cells come back as transform.
KEPT = ("upload", "model", "clean", "analysis")
OUTPUT = "array<struct<type:string,data:string>>"
#: What a document says of a cell besides its source; absent columns of the cells are null.
CELL = {"title": "string", "operation": "string", "columns": "array<string>", "dataset_ids": "array<string>", "source_cell_ids": "array<string>", "depends_on": "array<string>", "execution_count": "int", "source": "string", "outputs": OUTPUT}
KEPT_METADATA = "type:string,status:string,title:string,operation:string,columns:array<string>,dataset_ids:array<string>,source_cell_ids:array<string>,depends_on:array<string>"
DOCUMENT = f"cells array<struct<cell_type:string,id:string,metadata:struct<{KEPT_METADATA}>,source:variant,execution_count:int,outputs:array<struct<output_type:string,data:map<string,string>,text:variant>>>>, metadata struct<id:string,workspace_id:string>, nbformat int, nbformat_minor int"


def write_notebooks(notebooks: DataFrame, path: str) -> None:
    """One JSON document a line, gzip-compressed."""
    notebooks.write.mode("overwrite").option("compression", "gzip").json(path)


def read_notebooks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty table where there is nothing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def described(title: Column, columns: Column, dataset_ids: Column, provenance: Column) -> Column:
    """The source of a code cell that has none: what it did, as comments."""
    listed = lambda name, values: F.when(F.size(values) > 0, F.concat(F.lit(f" {name}: "), F.array_join(values, ", "))).otherwise("")
    head = F.coalesce(F.when(title != "", title), F.trim(F.concat("type", F.lit(" — "), F.coalesce("operation", F.lit("")))))
    return F.concat(F.lit("# "), head, F.lit("\n# cell "), F.col("idx").cast("string"), F.lit(" ["), "type", F.lit("] status="), "status", listed("columns", columns), listed("datasets", dataset_ids), F.lit("\n# provenance: "), F.to_json(provenance))


def shown(output: Column) -> Column:
    """An output as nbformat has it: errors by name, anything else as data to display, its text shortened."""
    data, cut = F.coalesce(output["data"], F.lit("")), lambda n: F.substring(F.coalesce(output["data"], F.lit("")), 1, n)
    whole = output["type"].isin("table", "dataset", "chart")
    mime = F.when(whole, F.create_map(F.lit("text/plain"), F.when(output["type"] == "chart", "[chart ]").otherwise(cut(TEXT_CHARS)), F.lit("application/json"), data)).otherwise(F.create_map(F.lit("text/plain"), cut(TEXT_CHARS)))
    failed = output["type"] == "error"
    # By name, as names given by alias() are lost where this is used within another lambda.
    return F.named_struct(
        F.lit("output_type"), F.when(failed, "error").otherwise("display_data"), F.lit("data"), F.when(~failed, mime), F.lit("metadata"), F.when(~failed, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
        F.lit("ename"), F.when(failed, "CellError"), F.lit("evalue"), F.when(failed, cut(ERROR_CHARS)), F.lit("traceback"), F.when(failed, F.array(cut(TEXT_CHARS))),
    )


def exported(notebooks: DataFrame, cells: DataFrame) -> DataFrame:
    """notebook_id, document: an nbformat 4.5 document of each notebook (id, workspace_id).

    cells: notebook_id, id, idx, type, status, and what there is of CELL.  A markdown cell without source shows its
    title; a code cell without one is described.
    """
    for name, kind in CELL.items():
        cells = cells.withColumn(name, F.col(name).cast(kind) if name in cells.columns else F.lit(None).cast(kind))
    markdown = F.col("type").isin("markdown", "assistant")
    links = F.struct("dataset_ids", "operation", "columns", "source_cell_ids", "depends_on")
    source = F.when(markdown, F.coalesce("source", "title", F.lit(""))).otherwise(F.coalesce(F.when(F.col("source") != "", F.col("source")), described(F.col("title"), F.col("columns"), F.col("dataset_ids"), links)))
    output = F.coalesce("outputs", F.array().cast(OUTPUT))
    cell = F.struct(
        "idx", F.when(markdown, "markdown").otherwise("code").alias("cell_type"), "id", F.struct("type", "status", "title", "operation", "columns", "dataset_ids", "source_cell_ids", "depends_on").alias("metadata"),
        source.alias("source"), F.when(~markdown, F.col("execution_count")).alias("execution_count"), F.when(~markdown, output).alias("outputs"),
    )
    # Cells and notebooks meet in one shuffle and one aggregation, in parts of a fixed number, which aren't merged for being
    # small when compressed; a sort of collected cells, as a join or a partial aggregate needs it, would spill them again.
    # Outputs are shown once they are together, as their shown form is larger.
    rows = cells.filter("notebook_id is not null").select("notebook_id", cell.alias("cell")).unionByName(notebooks.select(F.col("id").alias("notebook_id"), F.struct("workspace_id").alias("notebook")), allowMissingColumns=True)
    parts = PARTS * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = rows.repartition(parts, "notebook_id").groupBy("notebook_id").agg(F.collect_list("cell").alias("cells"), F.collect_list("notebook").alias("notebooks"))
    # data and metadata are maps, which have no order: the cells are sorted by their place and id alone
    before = lambda x, y: F.when((x["idx"] < y["idx"]) | ((x["idx"] == y["idx"]) & (x["id"] < y["id"])), -1).when((x["idx"] == y["idx"]) & (x["id"] == y["id"]), 0).otherwise(1)
    both = per.select("notebook_id", F.explode("notebooks").alias("notebook"), F.transform(F.array_sort("cells", before), lambda c: c.dropFields("idx").withField("outputs", F.transform(c["outputs"], shown))).alias("cells"))
    both = both.select("notebook_id", "notebook.workspace_id", "cells")
    about = F.struct(F.struct(F.lit("quillmark").alias("display_name"), F.lit("python").alias("language"), F.lit("python3").alias("name")).alias("kernelspec"), F.struct(F.lit("python").alias("name")).alias("language_info"), F.col("notebook_id").alias("id"), "workspace_id")
    document = F.struct("cells", about.alias("metadata"), F.lit(4).alias("nbformat"), F.lit(5).alias("nbformat_minor"))
    return both.select("notebook_id", F.to_json(document).alias("document"))


def imported(documents: DataFrame) -> DataFrame:
    """The cells of documents (one JSON text a row): notebook_id, workspace_id, id, idx, type, status, and CELL.

    Sources and texts may be one string or a list of lines.  The title is that of the metadata, else the first line of
    the source.  Errors come back as errors, other outputs as texts.
    """
    whole = lambda v: F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), ""), F.try_variant_get(v, "$", "string"), F.lit(""))
    parsed = documents.select(F.from_json("document", DOCUMENT).alias("d"))
    cells = parsed.select(F.col("d.metadata.id").alias("notebook_id"), F.col("d.metadata.workspace_id").alias("workspace_id"), F.posexplode("d.cells").alias("at", "c")).withColumn("source", whole(F.col("c.source")))
    named, m = F.col("c.metadata.type"), F.col("c.metadata")
    kind = F.when((F.col("c.cell_type") == "markdown") | named.isin("markdown", "assistant"), "markdown").when(named.isin(*KEPT), named).otherwise("transform")
    first = F.substring(F.regexp_replace(F.substring_index("source", "\n", 1), r"^#\s*", ""), 1, TITLE_CHARS)
    outputs = F.transform(F.coalesce("c.outputs", F.array().cast("array<struct<output_type:string,data:map<string,string>,text:variant>>")), lambda o: F.struct(F.when(o["output_type"] == "error", "error").otherwise("text").alias("type"), F.coalesce(F.try_element_at(o["data"], F.lit("text/plain")), whole(o["text"])).alias("data")))
    return cells.select(
        "notebook_id", "workspace_id", F.coalesce("c.id", F.concat(F.lit("cell-"), F.col("at").cast("string"))).alias("id"), (F.col("at") + 1).alias("idx"), kind.alias("type"), F.coalesce(m["status"], F.lit("active")).alias("status"), "source",
        F.coalesce(m["title"], first).alias("title"), m["operation"].alias("operation"), m["columns"].alias("columns"), F.coalesce(m["dataset_ids"], F.array().cast("array<string>")).alias("dataset_ids"),
        m["source_cell_ids"].alias("source_cell_ids"), m["depends_on"].alias("depends_on"), F.col("c.execution_count").alias("execution_count"), outputs.alias("outputs"),
    )
