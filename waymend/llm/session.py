"""What the operators of this subpackage take from the library's session helpers, and the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, cut, shared_folder

__all__ = ["bucketed", "bucketed_at", "checkpoint_dir", "cut", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed_at(spark: SparkSession, path: str, schema: str, col: str, buckets: int) -> DataFrame:
    """A table that bucketed() has written, perhaps in another session, as one of the same buckets."""
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({col}) SORTED BY ({col}) INTO {buckets} BUCKETS")
    return spark.table(name)


def bucketed(df: DataFrame, col: str, buckets: int, shuffled: bool = True, by: str | None = None, path: str | None = None) -> DataFrame:
    """df as a table at path, by default in the shared folder, in buckets by col, each sorted by it: tables of one number of buckets meet without a shuffle.

    shuffled=False: df comes bucket by bucket already, as what is read of such tables does.
    by: a column of few values that folders are split by first.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    folder = path or shared_folder(spark)
    if shuffled:
        df = df.repartition(buckets, col)
    writer = df.write.bucketBy(buckets, col).sortBy(col).option("path", folder).format("parquet")
    (writer.partitionBy(by) if by else writer).saveAsTable(name)
    return spark.table(name)
