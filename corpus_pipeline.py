"""A corpus from raw documents to shards, each stage one operator of waymend.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymend.llm.decontaminate import contaminated, decontaminate
from waymend.llm.minhash import near_duplicates
from waymend.llm.mixing import mixed_documents
from waymend.llm.names import Inner
from waymend.llm.quality import fit, quality_rules
from waymend.llm.session import shared_folder, table
from waymend.llm.sharding import shard_rows
from waymend.session import with_library

#: Shingles of five words, the library's default.
SHINGLE_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, all their columns with them.

    Null and empty texts and those under 50 words go; repeated rows are judged alike. Without usable labels the
    base rules alone decide. An empty table gives an empty table.
    """
    field, inner = fit(docs, table(spark, sf_dir, "labels")), Inner(docs)
    return quality_rules(inner.df, field, inner.at("text")).where("kept").select(*inner.outer())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest id. Rows of a null id stay.

    Where a doc_id stands more than once, its rows are told apart by their
    texts: of rows that are equal in both one stays, of others only those that are near-duplicates go.
    """
    inner = Inner(docs)
    id_, text = inner.col("doc_id"), inner.at("text")
    own = inner.df.where(id_.isNotNull())
    if own.groupBy(id_).count().where("count > 1").isEmpty():
        keepers = near_duplicates(own, inner.at("doc_id"), text, shingle=SHINGLE_WORDS).where("doc_id = component_id").select("doc_id")
        kept = own.join(keepers, id_ == F.col("doc_id"), "left_semi")
    else:
        key = F.concat_ws("-", F.lpad(id_.cast("string"), 20, "0"), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
        named = own.withColumn("key", key)
        keepers = near_duplicates(named, "key", text, shingle=SHINGLE_WORDS).where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
        kept = named.join(keepers, "key", "left_semi").dropDuplicates(["key"]).drop("key")
    return kept.unionByName(inner.df.where(id_.isNull())).select(*inner.outer())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark text contaminates, all their columns with them.

    Null and empty texts have no words and stay; repeated rows are judged alike. An empty table, or an empty
    benchmark, leaves all as it is.
    """
    inner = Inner(docs)
    return decontaminate(inner.df, table(spark, sf_dir, "benchmark"), inner.at("text")).where(~contaminated()).select(*inner.outer())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: a document as often as the mix takes it, three times at the most.

    A null source is a source. Null and empty texts have no words: they come and go with their id's hash and
    count for nothing. Repeated rows are taken alike. An empty table gives an empty table.
    """
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it: columns shard and slot in place of any of these names.

    Null ids are placed as one key, null and empty texts like others, repeated rows one after the other. An empty
    table gives an empty table.
    """
    return shard_rows(docs, "doc_id")


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No SQL can express the quality stage (a fitted field, decoded by Viterbi); tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in a folder of the shared one, which goes with the session, and read again."""
    with_library(spark)
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
