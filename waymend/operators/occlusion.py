"""Synthetic occlusions over image tiles, for training under cover: shadow polygons, tree canopies, clouds.

Every shape is a row, drawn by MD5 of its tile, the seed and its number, so that
runs and engines agree. Shapes are filled as relations of pixels, an edge of a
polygon crossing a row at one place; the covers are blurred in two passes and
laid over the image one after the other, in the image's task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import cut
from . import raster
from .cells import column
from .raster import PIXEL, augment, check_blur, gaussian_blur, gaussian_line, grid, inside, reflected_blur

#: Least and most corners of a shadow, shares of its radius, what it leaves of the light, widths of blurs.
CORNERS, CORNER_REACH, SHADE = (3, 6), (0.6, 1.2), (0.25, 0.55)
BLURS = {"shadow": 21, "canopy": 31, "cloud": 51}
LEAST_RADIUS = {"shadow": 20, "canopy": 25, "cloud": 40}
CANOPY_RADIUS, CANOPY_GREEN, CLOUD_OPACITY = 59, (90, 129), (0.6, 0.9)
CANOPY_RED_BLUE, CLOUD_COLOUR = (25, 30), (240, 245, 250)


def draw(name: str, *more: str, seed: int) -> Column:
    """From 0 up to 1, drawn by MD5 of the tile, the seed, a name and the columns of `more`."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", "tile_id", F.lit(str(seed)), F.lit(name), *more)), 1, 8), 16, 10).cast("long") / float(1 << 32)


def whole(share: Column, least: int, most: int) -> Column:
    """A whole number from least to most."""
    return (least + F.floor(share * (most - least + 1))).cast("int")


def between(share: Column, least: float, most: float) -> Column:
    return least + share * (most - least)


def largest_radius(kind: str, height: int, width: int) -> int:
    """Of a shadow a quarter of the smaller side, of a cloud a third, both exclusive; at least the least one, so that small tiles have shapes too."""
    if kind == "canopy":
        return CANOPY_RADIUS
    return max(LEAST_RADIUS[kind], min(height, width) // (4 if kind == "shadow" else 3) - 1)


def shapes(tiles: DataFrame, kind: str, count: int, height: int, width: int, seed: int = 42) -> DataFrame:
    """tile_id, k, cx, cy and the numbers of the kind's shapes: `count` for each tile (tile_id)."""
    d = lambda name: draw(f"{kind}-{name}", "k", seed=seed)
    rows = tiles.select("tile_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)) if count else F.array().cast("array<int>")))
    rows = rows.select("tile_id", "k", whole(d("x"), 0, width - 1).alias("cx"), whole(d("y"), 0, height - 1).alias("cy"), d("a").alias("a"), d("b").alias("b"), d("c").alias("c"), d("d").alias("d"))
    most = largest_radius(kind, height, width)
    radius = whole(F.col("a"), LEAST_RADIUS[kind], most)
    if kind == "shadow":
        return rows.select("tile_id", "k", "cx", "cy", radius.alias("radius"), whole(F.col("b"), *CORNERS).alias("corners"), between(F.col("c"), *SHADE).alias("light"))
    if kind == "canopy":
        return rows.select("tile_id", "k", "cx", "cy", radius.alias("rx"), whole(F.col("b"), LEAST_RADIUS[kind], most).alias("ry"), whole(F.col("c"), 0, 179).alias("turn"), whole(F.col("d"), *CANOPY_GREEN).alias("green"))
    return rows.select("tile_id", "k", "cx", "cy", radius.alias("rx"), radius.alias("ry"), F.lit(0).alias("turn"), between(F.col("b"), *CLOUD_OPACITY).alias("opacity"))


def polygon_corners(shadows: DataFrame, seed: int = 42) -> DataFrame:
    """tile_id, k, at, y, x: whole corners of each shadow, at falling or equal angles no more than its number of corners."""
    rows = shadows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("corners") - 1)))
    angle = 2 * math.pi * draw("shadow-angle", "k", "i", seed=seed)
    reach = F.col("radius") * between(draw("shadow-reach", "k", "i", seed=seed), *CORNER_REACH)
    rows = rows.select("tile_id", "k", "i", angle.alias("angle"), reach.alias("reach"), "cy", "cx")
    at = F.row_number().over(Window.partitionBy("tile_id", "k").orderBy("angle", "i")) - 1
    # Cut towards 0, as whole pixels are.
    return rows.select("tile_id", "k", at.alias("at"), (F.col("cy") + F.col("reach") * F.sin("angle")).cast("int").alias("y"), (F.col("cx") + F.col("reach") * F.cos("angle")).cast("int").alias("x"))


def filled_polygons(corners: DataFrame, height: int, width: int) -> DataFrame:
    """tile_id, k, y, x: the pixels inside polygons (tile_id, k, at, y, x: corners in order), edges and corners among them.

    A pixel is inside if an odd number of edges cross its row on one side of it. Each edge gives one crossing
    for each row that it passes, the crossings of a row in order pair up, and what lies between is filled.
    """
    order = Window.partitionBy("tile_id", "k").orderBy("at")
    first = F.first(F.struct("y", "x")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = corners.withColumn("b", F.coalesce(F.lead(F.struct("y", "x")).over(order), first)).select("tile_id", "k", "at", F.col("y").alias("ya"), F.col("x").alias("xa"), F.col("b.y").alias("yb"), F.col("b.x").alias("xb"))
    low, high = F.greatest(F.least("ya", "yb"), F.lit(0)), F.least(F.greatest("ya", "yb"), F.lit(height - 1))
    along = F.explode(F.when(low <= high, F.sequence(low, high)))
    lines = ends.withColumn("y", along)
    place = F.col("xa") + (F.col("y") - F.col("ya")) * (F.col("xb") - F.col("xa")) / F.nullif(F.col("yb") - F.col("ya"), F.lit(0))
    # An edge counts at its lower end, not at its upper one, so that a corner between two edges counts once or twice as it should.
    crossing = lines.where("ya <> yb AND y < greatest(ya, yb)").select("tile_id", "k", "y", place.alias("x"), "at")
    n = F.row_number().over(Window.partitionBy("tile_id", "k", "y").orderBy("x", "at")) - 1
    pairs = crossing.withColumn("n", n).groupBy("tile_id", "k", "y", F.floor(F.col("n") / 2).alias("pair")).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    # The edges themselves: the nearest pixel of each row, or the whole stretch of a level edge.
    drawn = lines.select("tile_id", "k", "y", F.when(F.col("ya") == F.col("yb"), F.least("xa", "xb").cast("double")).otherwise(F.floor(place + 0.5)).alias("a"), F.when(F.col("ya") == F.col("yb"), F.greatest("xa", "xb").cast("double")).otherwise(F.floor(place + 0.5)).alias("b"))
    spans = pairs.select("tile_id", "k", "y", "a", "b").unionByName(drawn)
    left, right = F.greatest(F.ceil("a"), F.lit(0)).cast("int"), F.least(F.floor("b"), F.lit(width - 1)).cast("int")
    return spans.select("tile_id", "k", "y", F.explode(F.when(left <= right, F.sequence(left, right))).alias("x")).distinct()


def filled_ellipses(rows: DataFrame, height: int, width: int) -> DataFrame:
    """tile_id, k, y, x: the pixels of ellipses (tile_id, k, cx, cy, rx, ry, turn in degrees)."""
    reach = F.greatest("rx", "ry")

    def span(centre: str, n: int) -> Column:
        low, high = F.greatest(F.col(centre) - reach, F.lit(0)), F.least(F.col(centre) + reach, F.lit(n - 1))
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    cells = rows.withColumn("y", span("cy", height)).withColumn("x", span("cx", width))
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    cos, sin = F.cos(F.radians("turn")), F.sin(F.radians("turn"))
    inside = F.pow((dx * cos + dy * sin) / F.col("rx"), 2) + F.pow((dy * cos - dx * sin) / F.col("ry"), 2) <= 1
    return cells.where(inside).select("tile_id", "k", "y", "x")


def soft_covers(cells: DataFrame, pixels: DataFrame, kind: str, count: int, height: int, width: int) -> DataFrame:
    """All pixels of cells with the blurred cover of each of a kind's shapes, as columns <kind>0, <kind>1, ...; pixels: tile_id, k, y, x."""
    names = [f"{kind}{k}" for k in range(count)]
    drawn = pixels.groupBy(*PIXEL).agg(*(F.max(F.when(F.col("k") == k, 1.0)).alias(name) for k, name in enumerate(names)))
    full = cells.join(drawn, PIXEL, "left").select(*PIXEL, *(F.coalesce(name, F.lit(0.0)).alias(name) for name in names))
    return gaussian_blur(full, names, height, width, BLURS[kind], 0.0)


def occlude(image: DataFrame, height: int, width: int, shadows: int = 3, canopies: int = 2, clouds: int = 1, seed: int = 42) -> DataFrame:
    """image (tile_id, y, x, r, g, b) under shadows, then canopies, then clouds, each in order; masks stay as they are.

    Channels are cut to 0 to 255 and truncated. Pixels may be missing. Images have to be larger than half of the widest blur.
    """
    counts = {"shadow": shadows, "canopy": canopies, "cloud": clouds}
    layers = [(kind, k) for kind, count in counts.items() for k in range(count)]
    for kind in dict(layers):
        check_blur(BLURS[kind], height, width)
    tiles = cut(image.select("tile_id").distinct())
    drawn = {kind: shapes(tiles, kind, count, height, width, seed) for kind, count in counts.items() if count}
    pixels = {kind: filled_polygons(polygon_corners(rows, seed), height, width) if kind == "shadow" else filled_ellipses(rows, height, width) for kind, rows in drawn.items()}
    laid = _laid_in_tasks if height * width <= raster.IMAGE_PIXELS else _laid_by_joins
    found = laid(image, tiles, layers, drawn, pixels, height, width) if layers else image
    # Rounded first: whole results must not fall by a last bit.
    whole_channel = lambda c: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(F.col(c).cast("double"), 6)))).cast("int").alias(c)
    return found.select(*PIXEL, *map(whole_channel, "rgb"))


#: The number that each kind's shapes have of their own.
OWN = {"shadow": "light", "canopy": "green", "cloud": "opacity"}


def laid_over(value, cover, own, kind: str, c: str):
    """A channel c under a cover of a kind, own: the shape's own number; columns or arrays."""
    if kind == "shadow":
        return value * (1 - cover * (1 - own))
    if kind == "canopy":
        return value * (1 - cover) + cover * (own if c == "g" else float(CANOPY_RED_BLUE["rb".index(c)]))
    return value * (1 - cover * own) + cover * own * CLOUD_COLOUR["rgb".index(c)]


def _laid_in_tasks(image: DataFrame, tiles: DataFrame, layers: list[tuple[str, int]], drawn: dict[str, DataFrame], pixels: dict[str, DataFrame], height: int, width: int) -> DataFrame:
    """An image and the pixels of its shapes are one task's group, which blurs the covers and lays them over."""
    size = height * width
    parts = None
    for kind in drawn:
        layer = F.col("k") + layers.index((kind, 0))
        # A pixel of a shape as one number, a shape's own number at -1 and below.
        at = pixels[kind].select("tile_id", (layer.cast("long") * size + F.col("y") * width + F.col("x")).alias("at"), F.lit(None).cast("double").alias("own"))
        both = at.unionByName(drawn[kind].select("tile_id", (-1 - layer.cast("long")).alias("at"), F.col(OWN[kind]).cast("double").alias("own")))
        parts = both if parts is None else parts.unionByName(both)
    schema = StructType([*(image.schema[c] for c in PIXEL), *(StructField(c, DoubleType()) for c in "rgb")])

    def lay(pixel: pa.Table, shape: pa.Table) -> pa.Table:
        at, number = column(shape, "at"), shape.column("own").fill_null(0.0).to_numpy()
        own = np.zeros(len(layers))
        own[-1 - at[at < 0]] = number[at < 0]
        covers = np.zeros(len(layers) * size)
        covers[at[at >= 0]] = 1.0
        covers = covers.reshape(len(layers), height, width)
        for kind in dict(layers):
            own_layers = [n for n, (of, _) in enumerate(layers) if of == kind]
            covers[own_layers] = reflected_blur(reflected_blur(covers[own_layers], 1, gaussian_line(BLURS[kind])), 2, gaussian_line(BLURS[kind]))
        covers = covers[:, column(pixel, "y"), column(pixel, "x")]
        done = []
        for c in "rgb":
            value = pixel.column(c).cast(pa.float64())
            channel = value.fill_null(0.0).to_numpy()
            for n, (kind, _) in enumerate(layers):
                channel = laid_over(channel, covers[n], own[n], kind, c)
            done.append(pa.array(channel, mask=value.is_null().to_numpy()))
        return pa.table([*(pixel.column(c) for c in PIXEL), *done], names=[*PIXEL, *"rgb"])

    on_image = inside(image.select(*PIXEL, *"rgb"), height, width).where("tile_id IS NOT NULL")
    return on_image.groupBy("tile_id").cogroup(parts.withColumnRenamed("tile_id", "of").groupBy("of")).applyInArrow(lay, schema)


def _laid_by_joins(image: DataFrame, tiles: DataFrame, layers: list[tuple[str, int]], drawn: dict[str, DataFrame], pixels: dict[str, DataFrame], height: int, width: int) -> DataFrame:
    """The same for images that no task should hold: covers are blurred by lines and joined pixel by pixel."""
    cells, found = grid(tiles, height, width), image.select(*PIXEL, *"rgb")
    for kind, rows in drawn.items():
        # A tile's numbers of this kind: one narrow row.
        numbers = rows.groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("k", OWN[kind]))).alias(kind))
        count = sum(of == kind for of, _ in layers)
        found = found.join(soft_covers(cells, pixels[kind], kind, count, height, width), PIXEL).join(numbers, "tile_id")

    def seen(c: str) -> Column:
        value = F.col(c).cast("double")
        for kind, k in layers:
            value = laid_over(value, F.col(f"{kind}{k}"), F.element_at(kind, k + 1)[OWN[kind]], kind, c)
        return value.alias(c)

    return found.select(*PIXEL, *map(seen, "rgb"))


def occluded_variants(image: DataFrame, height: int, width: int, shadows: int = 2, canopies: int = 2, clouds: int = 1, seed: int = 42) -> DataFrame:
    """Training variants: occluded first, then flipped, turned and brightened as augment() does; masks go through augment() alone, under the same seed."""
    return augment(occlude(image, height, width, shadows, canopies, clouds, seed), height, width, seed)
