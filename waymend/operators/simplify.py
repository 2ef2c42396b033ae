"""Street networks without the nodes that only shape a street."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .chains import follow


def street_ends(ways: DataFrame) -> DataFrame:
    """id, ends: whether a street ends or branches at each node of directed ways (u, v).

    It passes through a node of two neighbours that it enters from one and leaves to the other, one way or both ways. All other nodes
    are ends: those with a way to themselves, with no way in or none out, with another number of neighbours, or where one side is one-way and the other is not.
    """
    links = ways.select("u", "v").distinct()
    sides = links.select(F.col("u").alias("id"), F.col("v").alias("other"), F.lit(1).alias("out"), F.lit(0).alias("back")).unionByName(links.select(F.col("v").alias("id"), F.col("u").alias("other"), F.lit(0).alias("out"), F.lit(1).alias("back")))
    per_side = sides.groupBy("id", "other").agg(F.sum("out").alias("out"), F.sum("back").alias("back"))
    nodes = per_side.groupBy("id").agg(F.count("*").alias("n"), F.sum("out").alias("out"), F.sum("back").alias("back"), F.max((F.col("id") == F.col("other")).cast("int")).alias("loop"))
    passes = (F.col("n") == 2) & (F.col("loop") == 0) & (F.col("out") == F.col("back")) & F.col("out").isin(1, 2)
    return nodes.select("id", (~passes).alias("ends"))


def simplified(ways: DataFrame) -> DataFrame:
    """u, v, length, parts: the streets between ends of directed ways (u, v, length), from u to v, lengths and numbers of ways summed up.

    Of parallel ways, and of parallel streets of one direction, the shortest stays, of equally long ones that of the fewest parts.
    Streets that lead back to their beginning and rings without an end go. Streets of any length take logarithmic rounds.
    """
    single = cut(ways.groupBy("u", "v").agg(F.min("length").alias("length")))
    ends = cut(street_ends(single))
    near = single.select(F.col("u").alias("id"), F.col("v").alias("other")).unionByName(single.select(F.col("v").alias("id"), F.col("u").alias("other")))
    inner = near.join(ends.where("NOT ends").select("id"), "id", "left_semi").groupBy("id").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    darts = single.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), "length", F.lit(1).cast("long").alias("parts"))
    darts = darts.join(inner.withColumnRenamed("id", "b"), "b", "left").withColumn("onward", F.when(F.col("low") == F.col("a"), F.col("high")).otherwise(F.col("low")))
    darts = darts.join(ends.select(F.col("id").alias("a"), F.col("ends").alias("first")), "a")
    found = follow(darts.select("a", "b", "onward", "first", "length", "parts"), ["length", "parts"]).where("first AND a <> end")
    return found.groupBy(F.col("a").alias("u"), F.col("end").alias("v")).agg(F.min(F.struct("length", "parts")).alias("s")).select("u", "v", "s.length", "s.parts")
