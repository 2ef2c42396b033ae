"""Ways of places on the earth drawn into the tiles that they cross."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def way_segments(points: DataFrame, box: tuple[float, float, float, float], tile: int, rows: int, columns: int) -> DataFrame:
    """ya, xa, yb, xb: the segments of ways (way_id, pos, lat, lon) in pixels of a raster of rows * columns tiles over box (min_lat, min_lon, max_lat, max_lon), the first row in the north."""
    min_lat, min_lon, max_lat, max_lon = box
    y = (F.lit(max_lat) - F.col("lat")) / (max_lat - min_lat) * (rows * tile - 1)
    x = (F.col("lon") - F.lit(min_lon)) / (max_lon - min_lon) * (columns * tile - 1)
    along = Window.partitionBy("way_id").orderBy("pos", "y", "x")
    placed = points.select("way_id", "pos", y.alias("y"), x.alias("x"))
    return placed.select("way_id", F.col("y").alias("ya"), F.col("x").alias("xa"), F.lead("y").over(along).alias("yb"), F.lead("x").over(along).alias("xb")).where("yb IS NOT NULL")


def clip_range(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The part of a segment, from 0 to 1, where a coordinate that goes from a to b lies between low and high; the first is above the second if there is none."""
    d = b - a
    s, t = (low - a) / F.nullif(d, F.lit(0.0)), (high - a) / F.nullif(d, F.lit(0.0))
    inside = (a >= low) & (a <= high)
    begin = F.when(d == 0, F.when(inside, 0.0).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(s, t)))
    end = F.when(d == 0, F.when(inside, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(s, t)))
    return begin, end


def dealt_segments(segments: DataFrame, tile: int, rows: int, columns: int, reach: float) -> DataFrame:
    """ty, tx, y0, x0, ya, xa, yb, xb: each segment once for each tile that it comes within reach of, with the ends of the part in there.

    A tile is asked only if it lies in the segment's bounding box, and taken only if clipping leaves something; a long slanting
    segment is so cut up among the tiles along its way.
    """

    def span(a: str, b: str, n: int) -> Column:
        low = F.greatest(F.lit(0), F.floor((F.least(a, b) - reach) / tile)).cast("int")
        high = F.least(F.lit(n - 1), F.floor((F.greatest(a, b) + reach) / tile)).cast("int")
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    cells = segments.withColumn("ty", span("ya", "yb", rows)).withColumn("tx", span("xa", "xb", columns))
    y0, x0 = F.col("ty") * tile, F.col("tx") * tile
    sides = [clip_range(F.col(a), F.col(b), at - reach, at + tile - 1 + reach) for a, b, at in (("ya", "yb", y0), ("xa", "xb", x0))]
    begin, end = F.greatest(sides[0][0], sides[1][0]), F.least(sides[0][1], sides[1][1])
    cells = cells.withColumn("begin", begin).withColumn("end", end).where("begin <= end")
    part = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    return cells.select("way_id", "ty", "tx", y0.alias("y0"), x0.alias("x0"), "ya", "xa", "yb", "xb", part("ya", "yb", "begin").alias("pa"), part("xa", "xb", "begin").alias("qa"), part("ya", "yb", "end").alias("pb"), part("xa", "xb", "end").alias("qb"))


def ways_to_tiles(points: DataFrame, box: tuple[float, float, float, float], tile: int, rows: int, columns: int, thickness: int = 5) -> DataFrame:
    """tile_id (row * columns + column), y, x in the tile: the pixels within thickness / 2 of ways (way_id, pos, lat, lon).

    Places outside the box count as far as their segments come into it. A way that crosses a border is drawn on both sides; a way of one point draws nothing.
    """
    half = thickness / 2
    dealt = dealt_segments(way_segments(points, box, tile, rows, columns), tile, rows, columns, half)

    def span(a: str, b: str, at: str) -> Column:
        low = F.greatest(F.col(at), F.floor(F.least(a, b) - half).cast("int"))
        high = F.least(F.col(at) + tile - 1, F.ceil(F.greatest(a, b) + half).cast("int"))
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    cells = dealt.withColumn("y", span("pa", "pb", "y0")).withColumn("x", span("qa", "qb", "x0"))
    dy, dx = F.col("yb") - F.col("ya"), F.col("xb") - F.col("xa")
    size = dy * dy + dx * dx
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("y") - F.col("ya")) * dy + (F.col("x") - F.col("xa")) * dx) / F.greatest(size, F.lit(1e-9)))))
    near = F.pow(F.col("y") - (F.col("ya") + t * dy), 2) + F.pow(F.col("x") - (F.col("xa") + t * dx), 2) <= half * half
    return cells.where(near).select((F.col("ty") * columns + F.col("tx")).alias("tile_id"), (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x")).distinct()
