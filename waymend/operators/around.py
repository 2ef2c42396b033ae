"""The network around a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import haversine_m
from ..session import cut
from .components import connected_components
from .relational import check_location, parallel_edge_min


def network_around(ways: DataFrame, places: DataFrame, latitude: float, longitude: float, radius_m: float) -> DataFrame:
    """u, v, weight, highway: the largest component of the ways (u, v, length, highway) between places (id, lat, lon) within the radius.

    Of parallel ways the shortest stays; of components of one size that with
    the least node. No way within the radius is an error, as is a place or
    radius out of range.
    """
    check_location(latitude, longitude, radius_m)
    near = places.where(haversine_m(F.col("lat"), F.col("lon"), F.lit(latitude), F.lit(longitude)) <= radius_m).select("id").distinct()
    inside = ways.where("u <> v").join(near.withColumnRenamed("id", "u"), "u", "left_semi").join(near.withColumnRenamed("id", "v"), "v", "left_semi")
    edges = cut(parallel_edge_min(inside.select("u", "v", "length", "highway")))
    labels = cut(connected_components(edges))
    largest = labels.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    if largest.isEmpty():
        raise ValueError("no ways within the radius")
    kept = labels.join(largest, "component", "left_semi").select(F.col("node").alias("u"))
    return edges.join(kept, "u", "left_semi").select("u", "v", "weight", "highway")
