"""What every operator needs of a session: a shared folder for tables that cut lineage, and enough partitions of a small input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes, as the optimizer estimates them, from which an input that lies in fewer partitions than there are cores is dealt out.
SPREAD_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that setting is absent, a session in one process gets a temporary folder; any other is refused.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/quillmark-shared"
    return found


def temporary_store(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a store that is deleted when the application ends."""
    path = f"{shared_folder(spark)}/quillmark-{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor loses nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def running_sums(df: DataFrame, group: str, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds sums of columns so far, in an order within each group: ranges of the order, and what lies before each.

    A task holds a range, never a group; of a group that spans several ranges, one row for each goes into the offsets.
    """
    spark, own = df.sparkSession, df.columns
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), group, *order)
    ranged = checkpointed(ranged.withColumn("_range", F.spark_partition_id()))
    so_far = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", group).agg(*(F.sum(c).alias(f"{name}_all") for name, c in sums.items()))
    starts = totals.select("_range", group, *(F.coalesce(F.sum(f"{name}_all").over(before), F.lit(0)).alias(f"{name}_start") for name in sums))
    inside = ranged.withColumns({name: F.sum(c).over(so_far) for name, c in sums.items()})
    return inside.join(starts, ["_range", group]).select(*own, *((F.col(name) + F.col(f"{name}_start")).alias(name) for name in sums))


def spread(df: DataFrame) -> DataFrame:
    """An input in few pieces, as one file of one row group is, dealt out to all cores.

    At scale inputs have more pieces than a session has cores; they stay as they are, without a shuffle.
    """
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if int(plan.optimizedPlan().stats().sizeInBytes()) < SPREAD_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
