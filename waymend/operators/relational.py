"""Projections, predicates and small joins of the network analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Closures that are looked at as scenarios of one network.
MOST_SCENARIOS = 1000


def valid_location(lat: Column, lon: Column, radius: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & radius.between(100, 5000)


def check_location(latitude: float, longitude: float, radius_m: float) -> None:
    """The same check for one query, before a plan is built."""
    if not (-90 <= latitude <= 90 and -180 <= longitude <= 180 and 100 <= radius_m <= 5000):
        raise ValueError(f"not a place or radius in range: {latitude}, {longitude}, {radius_m}")


def parallel_edge_min(edges: DataFrame) -> DataFrame:
    """One edge u <= v for each pair of nodes: the shortest, of equal ones the first by highway; u, v, weight, highway."""
    return edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct("length", "highway")).alias("e")).select("u", "v", F.col("e.length").alias("weight"), F.col("e.highway").alias("highway"))


def affected_km(edges: DataFrame) -> DataFrame:
    """id, km: the length of the edges at each node; a missing weight counts 0."""
    ends = edges.select(F.col("u").alias("id"), "w").union(edges.select("v", "w"))
    return ends.groupBy("id").agg((F.sum(F.coalesce("w", F.lit(0))) / 1000).alias("km"))


def node_removal(edges: DataFrame, closures: DataFrame, most: int = MOST_SCENARIOS) -> DataFrame:
    """closed, u, v, w: the network without each of the closed nodes, a scenario for each; at most `most` of them, else an error."""
    nodes = [r[0] for r in closures.select("closed").distinct().limit(most + 1).collect()]
    if len(nodes) > most:
        raise ValueError(f"more than {most} scenarios")
    scenarios = F.array(*map(F.lit, nodes)) if nodes else F.array().cast("array<long>")
    return edges.withColumn("closed", F.explode(scenarios)).where("u <> closed AND v <> closed").select("closed", "u", "v", "w")


def edge_geometry(edges: DataFrame, places: DataFrame) -> DataFrame:
    at = places.select("id", "y", "x")
    return edges.join(at.toDF("u", "yu", "xu"), "u").join(at.toDF("v", "yv", "xv"), "v").select("u", "v", "yu", "xu", "yv", "xv")


def edge_style(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """colour, width and opacity of each edge: those at a closed node (closed) stand out."""
    shut = closed.select(F.col("closed").alias("u")).distinct()
    at_u = shut.withColumn("hit_u", F.lit(True))
    at_v = shut.select(F.col("u").alias("v"), F.lit(True).alias("hit_v"))
    styled = edges.join(at_u, "u", "left").join(at_v, "v", "left")
    hit = F.coalesce("hit_u", "hit_v", F.lit(False))
    return styled.select("u", "v", F.when(hit, "red").otherwise("green").alias("colour"), F.when(hit, 5).otherwise(2).alias("width"), F.when(hit, 0.9).otherwise(0.6).alias("opacity"))


def node_style(nodes: DataFrame) -> DataFrame:
    """id, colour, radius from is_closed and is_critical."""
    return nodes.select("id", F.when(F.col("is_closed"), "red").when(F.col("is_critical"), "orange").otherwise("blue").alias("colour"), F.when(F.col("is_closed"), 10).when(F.col("is_critical"), 7).otherwise(4).alias("radius"))


def kpi_flags(rows: DataFrame) -> DataFrame:
    """Adds index_low and impact_high to rows with resilience_index and travel_time_impact_pct."""
    return rows.withColumn("index_low", F.col("resilience_index") < 0.8).withColumn("impact_high", F.col("travel_time_impact_pct") > 5)


def polyline_length(points: DataFrame) -> DataFrame:
    """path_id, length: distances of consecutive points (path_id, pos, y, x) summed up; points of one pos go by y, x."""
    along = Window.partitionBy("path_id").orderBy("pos", "y", "x")
    step = F.sqrt(F.pow(F.col("y") - F.lag("y").over(along), 2) + F.pow(F.col("x") - F.lag("x").over(along), 2))
    return points.withColumn("step", step).groupBy("path_id").agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def running_best(rows: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Adds is_best: no earlier row of the key scores higher; the first row is best."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("is_best", F.coalesce(F.col(score) >= F.max(score).over(before), F.lit(True)))


def positional_split(rows: DataFrame, key: str, order: list[str], share: float = 0.8) -> DataFrame:
    """Adds split: the first floor(share * n) rows of each key are train, the others val."""
    n = F.count("*").over(Window.partitionBy(key))
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("split", F.when(k <= F.floor(n * share), "train").otherwise("val"))


def geo_to_pixel(points: DataFrame, box: tuple[float, float, float, float], height: int, width: int) -> DataFrame:
    """Adds py, px: the pixel of lat, lon in a box (min_lat, min_lon, max_lat, max_lon), row 0 at the top; truncated."""
    min_lat, min_lon, max_lat, max_lon = box
    x = ((F.col("lon") - min_lon) / (max_lon - min_lon) * (width - 1)).cast("int")
    y = ((max_lat - F.col("lat")) / (max_lat - min_lat) * (height - 1)).cast("int")
    return points.withColumn("py", y).withColumn("px", x)


def epoch_means(batches: DataFrame) -> DataFrame:
    """epoch, loss: the mean loss of an epoch's batches (epoch, loss, n) weighted by their sizes; 0 for an epoch without rows."""
    return batches.groupBy("epoch").agg(F.coalesce(F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")), F.lit(0.0)).alias("loss"))


def sample_rows(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows, those of the least MD5 of key and seed: the same ones in every run."""
    drawn = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    return rows.orderBy(drawn, key).limit(k)
