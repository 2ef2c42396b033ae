"""Session helpers shared by the whole library."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = str(Path(__file__).resolve().parent.parent)


def with_library(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library where the session was started without it on its path.

    On a cluster the package is shipped with --py-files; the path then does no harm.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a folder of this machine only where the master is local and none is set."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession) -> str:
    """The path of a new folder in the checkpoint folder, which goes when the driver's JVM ends."""
    folder = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df as a table written in the shared checkpoint folder: what follows restarts from there, and a lost executor costs nothing more.

    The shuffle files that led to it go at once, so that long chains of steps hold only their tables.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def ranked(df: DataFrame, col: str, name: str = "rank") -> DataFrame:
    """df with the rank of each row by col, from 0, without bringing the rows to one task.

    Rows are range-partitioned by col and numbered within partitions; only the
    partitions' sizes are summed up.
    """
    dealt = cut(df.repartitionByRange(F.col(col)).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").count()
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.__part") < F.col("a.__part"), "left").groupBy(F.col("a.__part").alias("__part")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(col)) - 1
    return dealt.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__within")).cast("long")).drop("__part", "__before", "__within")


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)
