"""Generated inputs: the demonstration grid, terrains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import PIXEL, grid, resize


def grid_graph(spark: SparkSession, side: int = 6) -> DataFrame:
    """Edges u, v, w of a side x side lattice; w from 50 to 200, by the MD5 of the edge."""
    cells = spark.range(side * side)
    right = cells.where(F.col("id") % side < side - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    down = cells.where(F.col("id") < side * (side - 1)).select(F.col("id").alias("u"), (F.col("id") + side).alias("v"))
    weight = 50 + F.conv(F.substring(F.md5(F.concat_ws("-", "u", "v")), 1, 8), 16, 10).cast("long") % 151
    return right.union(down).select("u", "v", weight.alias("w"))


def grid_places(spark: SparkSession, side: int = 6, latitude: float = 12.97, longitude: float = 77.59, step: float = 0.003) -> DataFrame:
    """id, lat, lon of the lattice's nodes: rows go north, columns east, `step` degrees apart."""
    cells = spark.range(side * side)
    return cells.select("id", (F.lit(latitude) + F.floor(F.col("id") / side) * step).alias("lat"), (F.lit(longitude) + F.col("id") % side * step).alias("lon"))


#: The colours of growth and of bare ground, how sharp the change between them is, the spread of the fine noise.
GREEN, BARE, SHARPNESS, GRAIN = (34, 112, 45), (140, 120, 95), 3, 10
#: Side of the cells that coarse noise is drawn for.
COARSE = 4


def normal(name: str, *place: str, seed: int = 42) -> Column:
    """A standard normal number drawn by MD5 of the seed, a name and the place's columns: the same wherever it is worked out."""
    drawn = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(name), *place))
    u, v = ((F.conv(F.substring(drawn, at, 8), 16, 10).cast("long") + 1) / float((1 << 32) + 1) for at in (1, 9))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def synthetic_tiles(tiles: DataFrame, height: int = 512, width: int = 512, seed: int = 42) -> DataFrame:
    """An RGB terrain (tile_id, y, x, r, g, b) for each of tiles (tile_id): growth and bare ground blended by coarse noise, fine noise on top.

    Coarse noise is drawn for cells of COARSE pixels and spread by cubic convolution. Every number follows from its
    place and the seed, so any partitioning gives the same tile. Sides are multiples of COARSE, of four cells at least.
    """
    if height % COARSE or width % COARSE:
        raise ValueError(f"sides must be multiples of {COARSE}")
    cells = grid(tiles.select("tile_id").distinct(), height // COARSE, width // COARSE)
    noise = resize(cells.withColumn("noise", normal("coarse", "tile_id", "y", "x", seed=seed)), ["noise"], height // COARSE, width // COARSE, height, width)
    share = 1 / (1 + F.exp(-SHARPNESS * F.col("noise")))
    colours = [a * share + b * (1 - share) + GRAIN * normal(c, "tile_id", "y", "x", seed=seed) for c, a, b in zip("rgb", GREEN, BARE)]
    return noise.select(*PIXEL, *(F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(v, 6)))).cast("int").alias(c) for c, v in zip("rgb", colours)))


def synthetic_tile(spark: SparkSession, height: int = 512, width: int = 512, seed: int = 42) -> DataFrame:
    """The terrain of one tile: y, x, r, g, b."""
    return synthetic_tiles(spark.range(1).select(F.lit(0).alias("tile_id")), height, width, seed).drop("tile_id")
