"""Knowledge records: their schema, normalisation, kinds, and the providers that make them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.coerce import js_round
from quillmark.functions.text import chunk_hash, source_hash

#: The kinds of records, and what older kinds became.
KINDS = ("notebook_cell", "notebook_output", "notebook_visualization", "dataset_profile", "column_semantic", "data_representative", "relationship", "error", "note", "functionality", "guide")
LEGACY_KINDS = {"cell": "notebook_cell", "dataset": "dataset_profile", "operation": "column_semantic", "result": "notebook_output", "statistic": "notebook_output", "export": "notebook_output", "visualization": "notebook_visualization"}
METADATA = "status string, source string, columns array<string>, column string, title string, operation string, dataset_ids array<string>, dataset_name string, extra map<string,string>"
PROVENANCE = "workspace_id string, notebook_id string, cell_id string, upload_id string, content_hash string, dataset_ids array<string>, dataset_name string, columns array<string>, operation string, source_cell_ids array<string>, depends_on array<string>, chunk_id string, row_indices array<int>, sample_coverage string"
RECORD = f"id string, workspace_id string, dataset_id string, notebook_id string, cell_id string, kind string, text string, metadata struct<{METADATA.replace(' string', ':string').replace(' array', ':array').replace(' map', ':map')}>, provenance struct<{PROVENANCE.replace(' string', ':string').replace(' array', ':array')}>, source_hash string, created_at timestamp, updated_at timestamp, _pos bigint"
RICH_COLUMNS, RELATION_TOP, TOGETHER_TOP, CATALOG_SCAN, CATALOG_KEEP = 12, 5, 10, 80, 12


def normalized_kind(kind: Column) -> Column:
    legacy = F.create_map(*(F.lit(x) for pair in LEGACY_KINDS.items() for x in pair))
    return F.when(kind.isin(*KINDS), kind).otherwise(F.coalesce(F.try_element_at(legacy, kind), F.lit("notebook_output")))


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)


def record_struct(schema: str, **values: Column) -> Column:
    """A struct of the schema's fields; those without a value are null."""
    depth, start, fields = 0, 0, []
    for k, ch in enumerate(schema + ","):
        depth += ch in "<(" or 0
        depth -= ch in ">)" or 0
        if ch == "," and not depth:
            fields.append(schema[start:k].strip().split(" ", 1))
            start = k + 1
    return F.struct(*(values.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))


def records(df: DataFrame, *, id: Column, kind: str | Column, text: Column, workspace: Column, metadata: dict[str, Column], provenance: dict[str, Column], dataset: Column | None = None, notebook: Column | None = None, cell: Column | None = None, hash_of: Column | None = None, at: Column | None = None, pos: Column | None = None) -> DataFrame:
    """Records of every row of df, in the fixed schema."""
    none = F.lit(None)
    at = none if at is None else at
    return df.select(
        id.cast("string").alias("id"), workspace.cast("string").alias("workspace_id"), (none if dataset is None else dataset).cast("string").alias("dataset_id"), (none if notebook is None else notebook).cast("string").alias("notebook_id"), (none if cell is None else cell).cast("string").alias("cell_id"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"), record_struct(METADATA, **metadata).alias("metadata"), record_struct(PROVENANCE, workspace_id=workspace, **provenance).alias("provenance"),
        source_hash(text if hash_of is None else hash_of).alias("source_hash"), at.cast("timestamp").alias("created_at"), at.cast("timestamp").alias("updated_at"), (F.lit(0) if pos is None else pos).cast("bigint").alias("_pos"),
    )


def normalized(df: DataFrame) -> DataFrame:
    """Records as they are stored and read: kind mapped; datasets, columns and operation filled from each other and from the metadata."""
    p, m = F.col("provenance"), F.col("metadata")
    datasets = F.coalesce(p["dataset_ids"], F.when(F.col("dataset_id").isNotNull(), F.array("dataset_id")), m["dataset_ids"], F.array().cast("array<string>"))
    name, operation = F.coalesce(p["dataset_name"], m["dataset_name"]), F.coalesce(p["operation"], m["operation"])
    columns = F.coalesce(p["columns"], m["columns"], F.when(m["column"].isNotNull(), F.array(m["column"])))
    provenance = p.withField("dataset_ids", datasets).withField("columns", columns).withField("dataset_name", name).withField("operation", operation).withField("workspace_id", F.coalesce(p["workspace_id"], F.col("workspace_id"))).withField("notebook_id", F.coalesce(p["notebook_id"], F.col("notebook_id"))).withField("cell_id", F.coalesce(p["cell_id"], F.col("cell_id")))
    return df.withColumn("kind", normalized_kind(F.col("kind"))).withColumn("dataset_id", F.coalesce("dataset_id", F.try_element_at(datasets, F.lit(1)))).withColumn("provenance", F.when(p.isNotNull(), provenance).otherwise(record_struct(PROVENANCE, workspace_id=F.col("workspace_id"), notebook_id=F.col("notebook_id"), cell_id=F.col("cell_id"), dataset_ids=datasets, columns=columns, dataset_name=name, operation=operation)))


def union_first(*frames: DataFrame) -> DataFrame:
    """Union by id in which the earlier frame wins."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other.join(out.select("id"), "id", "left_anti").select(*other.columns))
    return out


# --- notebook cells -------------------------------------------------------------------------------------------------


def _listed(prefix: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(prefix), F.array_join(values, ", "))).otherwise("")


def cell_narrative(cell: str = "cell") -> Column:
    """One sentence on a cell: cells have idx, type, status, dataset_ids, operation, columns, markdown."""
    c = lambda n: F.col(f"{cell}.{n}")
    status = F.when(c("status") == "superseded", " (superseded, historical)").when(c("status") == "stale", " (stale, inputs changed)").otherwise("")
    data = F.when(F.size(c("dataset_ids")) > 1, _listed(" datasets ", c("dataset_ids"))).otherwise(_listed(" dataset ", c("dataset_ids")))
    operation = F.when(F.length(c("operation")) > 0, F.concat(F.lit(" operation "), c("operation"))).otherwise("")
    columns = _listed(" columns ", c("columns"))
    head = F.concat(F.lit("Cell "), c("idx").cast("string"), F.lit(" ["))
    say = lambda kind, *parts: F.concat(head, kind if isinstance(kind, Column) else F.lit(kind), F.lit("]"), status, *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return (
        F.when(c("type") == "upload", say("upload", " loaded", data, "."))
        .when(c("type") == "inspect", say("inspect", " inspected", data, columns, "."))
        .when(c("type").isin("model", "transform", "clean", "analysis", "visualization"), say(c("type"), operation, columns, " on", data, "."))
        .when(c("type") == "export", say("export", " exported", data, "."))
        .when(c("type") == "markdown", say("note", ": ", F.coalesce(F.substring(c("markdown"), 1, 200), F.lit(""))))
        .otherwise(say(c("type"), " on", data, "."))
    )


def output_narrative(cell: str = "cell", output: str = "output") -> Column:
    """One sentence on an output (id, type, title, row_count, columns, chart_type, data as JSON text); null for unknown types."""
    o, idx = lambda n: F.col(f"{output}.{n}"), F.col(f"{cell}.idx").cast("string")
    title = F.when(F.length(o("title")) > 0, F.concat(F.lit(' "'), o("title"), F.lit('"'))).otherwise("")
    number = lambda path: F.coalesce(F.get_json_object(o("data"), path).try_cast("bigint"), F.lit(0))
    counted = [F.when(number(p) != 0, F.concat(number(p).cast("string"), F.lit(f" {what}"))) for p, what in (("$.rowsRemoved", "rows removed"), ("$.rowsAdded", "rows added"), ("$.valuesChanged", "values changed"))]
    changes = F.concat_ws(", ", *counted)
    rows, columns = F.coalesce(o("row_count").cast("string"), F.lit("?")), F.coalesce(F.array_join(o("columns"), ", "), F.lit(""))
    say = lambda *parts: F.concat(F.lit("Cell "), idx, *(F.lit(p) if isinstance(p, str) else p for p in parts))
    chart = F.coalesce(o("chart_type"), F.get_json_object(o("data"), "$.chartType"), F.lit("unknown"))
    raw = F.coalesce(o("data"), F.lit(""))
    return (
        F.when((o("type") == "diff") & (changes == ""), say(" produced a diff."))
        .when(o("type") == "diff", say(" diff", title, ": ", changes, "."))
        .when(o("type") == "table", say(" table", title, " with ", rows, " rows, columns ", columns, "."))
        .when(o("type") == "chart", say(" chart", title, " type ", chart, " ", F.when(o("columns").isNotNull(), F.concat(F.lit("for "), columns)).otherwise(""), "."))
        .when(o("type") == "metric", say(" metric", title, ": ", F.substring(raw, 1, 300)))
        .when(o("type") == "error", say(" error", title, ": ", F.substring(raw, 1, 300)))
        .when(o("type") == "text", say(" note", title, ": ", F.substring(raw, 1, 400)))
        .when(o("type") == "dataset", say(" dataset", title, ": ", rows, " rows."))
        .when(o("type") == "file", say(" file", title, ": ", F.coalesce(F.get_json_object(o("data"), "$.fileName"), F.lit(""))))
    )


def output_kind(kind: Column) -> Column:
    return F.when(kind == "chart", "notebook_visualization").when(kind == "error", "error").otherwise("notebook_output")


def notebook_records(notebooks: DataFrame, cells: DataFrame) -> DataFrame:
    """Narratives, outputs, per-column operations and a summary of every notebook.

    notebooks: id, workspace_id, created_at; cells: notebook_id, id, idx, type, status, dataset_ids, operation, columns,
    markdown, source_cell_ids, depends_on, outputs (array of structs), created_at.
    """
    both = cells.join(notebooks.select(F.col("id").alias("notebook_id"), "workspace_id"), "notebook_id")
    c = both.select("workspace_id", "notebook_id", F.struct(*cells.columns).alias("cell"))
    base = dict(workspace=F.col("workspace_id"), notebook=F.col("notebook_id"), cell=F.col("cell.id"), dataset=F.try_element_at(F.col("cell.dataset_ids"), F.lit(1)), at=F.col("cell.created_at"), pos=F.col("cell.idx"))
    source = dict(notebook_id=F.col("notebook_id"), cell_id=F.col("cell.id"), dataset_ids=F.col("cell.dataset_ids"), operation=F.col("cell.operation"))
    meta = dict(status=F.col("cell.status"), operation=F.col("cell.operation"), columns=F.col("cell.columns"))
    link = dict(source_cell_ids=F.col("cell.source_cell_ids"), depends_on=F.col("cell.depends_on"))
    narratives = records(c, id=F.concat("cell.id", F.lit("::narrative")), kind="notebook_cell", text=cell_narrative(), metadata=meta | {"source": F.lit("notebook_cell")}, provenance=source | link | {"columns": F.col("cell.columns")}, **base)
    outputs = c.select("*", F.explode("cell.outputs").alias("output")).withColumn("said", output_narrative()).filter("said is not null")
    said = records(outputs, id=F.concat(F.col("cell.id"), F.lit("::output:"), F.col("output.id")), kind=output_kind(F.col("output.type")), text=F.col("said"), metadata=meta | {"source": F.lit("notebook_output"), "title": F.col("output.title")}, provenance=source | link | {"columns": F.col("cell.columns")}, hash_of=F.concat_ws(":", F.col("cell.id"), F.col("output.id"), F.col("said")), **base)
    changed = c.filter(F.col("cell.type").isin("clean", "transform", "model")).select("*", F.explode("cell.columns").alias("column"))
    operation = F.coalesce(F.col("cell.operation"), F.col("cell.type"))
    on = F.coalesce(F.concat(F.lit(" on dataset "), F.try_element_at(F.col("cell.dataset_ids"), F.lit(1))), F.lit(""))
    affected = F.concat(F.lit("Cell "), F.col("cell.idx").cast("string"), F.lit(" "), operation, F.lit(' affected column "'), F.col("column"), F.lit('"'), on, F.lit("."))
    operations = records(changed, id=F.concat(F.col("cell.id"), F.lit("::col:"), F.col("column")), kind="column_semantic", text=affected, metadata={"source": F.lit("notebook_cell"), "column": F.col("column"), "operation": operation}, provenance=source | {"columns": F.array("column"), "operation": operation}, **base)
    per = both.groupBy("workspace_id", "notebook_id").agg(F.count("*").alias("cells"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("dataset_ids")))).alias("ids"), F.min("created_at").alias("at"))
    names = F.when(F.size("ids") > 0, F.array_join("ids", ", ")).otherwise("none")
    summary = F.concat(F.lit("Workspace "), "workspace_id", F.lit(" notebook contains "), F.col("cells").cast("string"), F.lit(" cells, datasets: "), names, F.lit("."))
    summaries = records(per, id=F.concat("notebook_id", F.lit("::summary")), kind="dataset_profile", text=summary, workspace=F.col("workspace_id"), notebook=F.col("notebook_id"), metadata={"source": F.lit("notebook_summary")}, provenance={"notebook_id": F.col("notebook_id")}, hash_of=F.concat(summary, F.col("notebook_id")), at=F.col("at"))
    return narratives.unionByName(said).unionByName(operations).unionByName(summaries)


# --- datasets -------------------------------------------------------------------------------------------------------


def header_text(name: Column, kind: Column) -> Column:
    return F.concat(F.lit('Column "'), name, F.lit('" is '), kind)


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, half up."""
    return F.format_string(f"%.{digits}f", js_round(c.cast("double"), digits))


def rich_text(numeric: bool) -> Column:
    """The sentence on a profiled column (column, kind, missing_pct, unique, and its statistics)."""
    head = F.concat(F.lit('Column "'), F.col("column"), F.lit('" ('), F.col("kind"), F.lit("): missing "), fixed(F.col("missing_pct"), 1), F.lit("% unique "), F.col("unique").cast("string"))
    if numeric:
        return F.concat(head, *(x for name, c in (("mean", "mean"), ("median", "median"), ("std", "std"), ("skew", "skewness")) for x in (F.lit(f", {name} "), fixed(F.col(c), 2))))
    top = F.array_join(F.transform("top", lambda t: F.concat(t["value"], F.lit(" "), fixed(t["pct"], 0), F.lit("%"))), ", ")
    return F.concat(head, F.lit(", top "), top, F.lit(", entropy "), fixed(F.col("entropy"), 2))


def dataset_description(df: DataFrame, file_name: str, kinds: dict[str, str], rows: int, objective: str | None = None) -> str:
    counts: dict[str, int] = {}
    for kind in kinds.values():
        counts[kind] = counts.get(kind, 0) + 1
    purpose = (objective or "").strip() or file_name.rsplit(".", 1)[0]
    types = ", ".join(f"{k}:{v}" for k, v in counts.items())
    return f'Dataset "{file_name}" purpose: {purpose} has {rows} rows and {len(kinds)} columns. Types: {types}. Columns: {", ".join(f"{c} ({k})" for c, k in kinds.items())}.'


def dataset_profile_text(row: dict) -> str:
    """The sentence on a row of dataset_profile()."""
    types = ", ".join(f"{k}:{v}" for k, v in row["column_count_by_type"].items())
    return f'RAG dataset profile: {row["rows"]} rows ×{row["cols"]} cols ({row["file_name"]}), duplicate {row["duplicate_pct"]:g}% ({row["duplicate_rows"]} rows), empty rows {row["empty_rows"]}, constant cols: {", ".join(row["constant_cols"]) or "none"}, types: {types}'


def fallback_text(name: str, dataset_id: str, columns: list[tuple[str, str, list[str] | None]], most_columns: int = 5, most_values: int = 3) -> str:
    """A stand-in for sampled rows: the first columns with their top values."""
    parts = (f"{c}({kind}) top {', '.join(top[:most_values]) if top is not None else 'n/a'}" for c, kind, top in columns[:most_columns])
    return f"Representative sample for {name} ({dataset_id}): {' | '.join(parts)}"


def dataset_records(spark: SparkSession, workspace: str, dataset_id: str, texts: list[tuple], name: str | None = None, content_hash: str | None = None) -> DataFrame:
    """Records of a dataset from (suffix of the id, kind, text, column), and for a chunk the positions of its rows.

    There is at most one for each column and chunk.
    """
    rows = [(k, *t[:4], t[4] if len(t) > 4 else None, int(t[0].rpartition(":")[2]) if len(t) > 4 else None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "pos int, suffix string, kind string, text string, column string, row_indices array<int>, chunk int")
    chunk = F.when(F.col("chunk").isNotNull(), chunk_hash(F.lit(content_hash or ""), F.col("chunk"), F.col("text")))
    columns = F.when(F.col("column").isNotNull(), F.array("column"))
    return records(df, id=F.concat(F.lit(f"dataset:{dataset_id}:"), "suffix"), kind=F.col("kind"), text=F.col("text"), workspace=F.lit(workspace), notebook=F.lit(f"nb:{workspace}"), dataset=F.lit(dataset_id), metadata={"source": F.col("kind"), "column": F.col("column"), "columns": columns}, provenance={"dataset_ids": F.array(F.lit(dataset_id)), "upload_id": F.lit(dataset_id), "dataset_name": F.lit(name), "content_hash": F.lit(content_hash), "columns": columns, "chunk_id": chunk, "row_indices": F.col("row_indices")}, pos=F.col("pos"))


def relationship_texts(dataset_id: str, together: DataFrame, keys: list[str], duplicates: tuple[int, float], composite: list[tuple[str, str]], quality: DataFrame, high: list[str], average: float) -> list[tuple[str, str]]:
    """(id, text) of relations in a profiled dataset; the tables hold a row for a pair or column, so they are small."""
    out = []
    for r in together.limit(TOGETHER_TOP).collect():
        out.append((f"rel:{dataset_id}:missingTogether:{r['a']}:{r['b']}", f'Relationship: columns "{r["a"]}" and "{r["b"]}" tend to be missing together (correlation {r["coefficient"]:.2f}) in dataset {dataset_id}'))
    if keys:
        out.append((f"rel:{dataset_id}:candidateKeys", f"Relationship: candidate key columns [{', '.join(keys[:RELATION_TOP])}] uniquely identify rows in dataset {dataset_id} (duplicate {duplicates[1]:g}% {duplicates[0]} rows)"))
    for pair in composite[:RELATION_TOP]:
        out.append((f"rel:{dataset_id}:composite:{'_'.join(pair)}", f"Relationship: composite key [{', '.join(pair)}] uniquely identifies rows in dataset {dataset_id}"))
    for r in quality.filter("invalid > 0").limit(RELATION_TOP).collect():
        out.append((f"rel:{dataset_id}:quality:{r['column']}:non-numeric", f'Relationship: column "{r["column"]}" has {r["invalid"]} invalid non-numeric values in dataset {dataset_id}'))
    if high:
        out.append((f"rel:{dataset_id}:highMissing", f"Relationship: columns with high missing rate in {dataset_id}: {', '.join(high)} (avg missing per row {average:.1f})"))
    return out


# --- catalogues -----------------------------------------------------------------------------------------------------

#: Our own small dictionary and capability tables: id, name, family, text.
DICTIONARY = (
    ("mean", "Mean", "centre", "The sum of values divided by their number."),
    ("median", "Median", "centre", "The middle value of an ordered list."),
    ("variance", "Variance", "spread", "The mean squared distance from the mean."),
    ("entropy", "Entropy", "spread", "How unpredictable a category is, in bits."),
    ("outlier", "Outlier", "quality", "A value far from the others."),
    ("missing", "Missing value", "quality", "A cell without a usable value."),
    ("key", "Candidate key", "structure", "Columns whose values identify each row."),
    ("correlation", "Correlation", "relation", "How closely two columns vary together."),
)
FUNCTIONALITIES = (
    ("t-test", "t-test", "comparison", "Compares the means of two groups.", True),
    ("anova", "Analysis of variance", "comparison", "Compares the means of several groups.", True),
    ("chi-square", "Chi-square test", "comparison", "Tests whether two categories depend on each other.", True),
    ("regression", "Linear regression", "model", "Predicts a number from other columns.", True),
    ("clustering", "Clustering", "model", "Finds groups of similar rows.", True),
    ("impute", "Imputation", "cleaning", "Fills missing values.", True),
    ("dedupe", "Duplicate removal", "cleaning", "Removes repeated rows.", True),
    ("forecast", "Forecast", "model", "Continues a series in time.", False),
)


def catalogue(spark: SparkSession, workspace: str, kind: str, prefix: str, rows) -> DataFrame:
    """Records of a fixed table; `kind` is note, functionality or guide."""
    df = spark.createDataFrame([(k, *r[:4], r[4] if len(r) > 4 else None) for k, r in enumerate(rows)], "pos int, key string, name string, family string, about string, verified boolean")
    known = F.create_map(F.lit("functionality_id"), "key", F.lit("ui_path"), F.concat("family", F.lit("/"), "key"), F.lit("verified"), F.col("verified").cast("string"))
    extra = F.when(F.col("verified").isNotNull(), known)
    text = F.concat("name", F.lit(" ("), "family", F.lit("): "), "about")
    return records(df, id=F.concat(F.lit(prefix), "key"), kind=kind, text=text, workspace=F.lit(workspace), metadata={"source": F.lit(kind), "title": F.col("name"), "extra": extra}, provenance={}, pos=F.col("pos"))


CORPUS = "key string, kind string, name string, family string, about string, ui_path string, verified boolean, place bigint"


def corpus(methods: DataFrame, groups: DataFrame, overlays: DataFrame | None = None, unverified: DataFrame | None = None, elsewhere: str = "analyse") -> DataFrame:
    """The capabilities that a catalogue in tables describes, in the schema CORPUS.

    methods: key, label, group, summary, place; groups: group, label, ui_path; overlays: key, kind (functionality or guide), name,
    family, about, ui_path, written by hand, which come after; unverified: keys of methods to flag.  A method whose group
    isn't there has the group's name and `elsewhere` as its place.  Of rows with one key the least stays, an overlay last.
    """
    known = groups.groupBy("group").agg(F.min(F.struct("label", "ui_path")).alias("g"))
    made = methods.filter("key is not null").join(known, "group", "left")
    family, ui = F.coalesce("g.label", "group"), F.coalesce("g.ui_path", F.lit(elsewhere))
    flagged = F.lit(True)
    if unverified is not None:
        made = made.join(unverified.select("key").distinct().withColumn("_flag", F.lit(False)), "key", "left")
        flagged = F.coalesce("_flag", F.lit(True))
    note = F.when(flagged, "").otherwise(" Note: experimental, its verification is pending.")
    about = F.concat(F.coalesce("summary", F.lit("")), F.lit(" Find it at "), ui, F.lit("."), note)
    out = made.select("key", F.lit("functionality").alias("kind"), F.col("label").alias("name"), family.alias("family"), about.alias("about"), ui.alias("ui_path"), flagged.alias("verified"), F.col("place").cast("bigint").alias("place"))
    if overlays is not None:
        out = out.unionByName(overlays.filter("key is not null").select("key", "kind", "name", "family", "about", "ui_path", F.lit(True).alias("verified"), (F.col("place") + F.lit(1 << 40)).cast("bigint").alias("place")))
    rest = [c for c in out.columns if c != "key"]
    first = out.groupBy("key").agg(F.min(F.struct("place", *(c for c in rest if c != "place"))).alias("_row"))
    return first.select("key", *(F.col(f"_row.{c}").alias(c) for c in rest))


def corpus_records(rows: DataFrame, workspace: str) -> DataFrame:
    """Records of rows of a corpus, in their order."""
    extra = F.create_map(F.lit("functionality_id"), "key", F.lit("ui_path"), "ui_path", F.lit("verified"), F.col("verified").cast("string"))
    text = F.concat("name", F.lit(" ("), "family", F.lit("): "), "about")
    return records(rows, id=F.concat(F.lit("func::"), "key"), kind=F.col("kind"), text=text, workspace=F.lit(workspace), metadata={"source": F.lit("functionality"), "title": F.col("name"), "extra": extra}, provenance={}, pos=F.col("place"))
