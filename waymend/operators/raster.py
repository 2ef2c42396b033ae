"""Masks as relations of foreground pixels (tile_id, y, x): set algebra, morphology, tiling, metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..session import cut
from .cells import CELL, Stack, column, grouped, parted

PIXEL = ["tile_id", "y", "x"]
#: Pixels around a cell that thinning sees, half as many iterations are done before cells meet again.
HALO = 16
#: Pixels of an image that one task's group holds where it is blurred or covered; larger images are taken line by line.
IMAGE_PIXELS = 1 << 20
NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def _shifts(offsets: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets)))


def shifted(mask: DataFrame, offsets: list[tuple[int, int]], *more: str) -> DataFrame:
    """Each pixel once for each offset, moved by it: tile_id, y, x, dy, dx and the columns named."""
    return mask.withColumn("d", _shifts(offsets)).select("tile_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), F.col("d.dy").alias("dy"), F.col("d.dx").alias("dx"), *more)


def inside(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return pixels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of the filled ellipse in a square of 2 * radius + 1: in each row, the rounded half-width of the circle."""
    found = []
    for dy in range(-radius, radius + 1):
        half = round(radius * math.sqrt(max(0.0, radius * radius - dy * dy)) / radius) if radius else 0
        found += [(dy, dx) for dx in range(-half, half + 1)]
    return found


def binarize(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pixels with p above the threshold; on a tile whose largest p is above 1, above 255 times it."""
    top = scores.groupBy("tile_id").agg(F.max("p").alias("top"))
    return scores.join(top, "tile_id").where(F.col("p") > F.when(F.col("top") > 1, threshold * 255).otherwise(threshold)).select(*PIXEL)


def pixel_adjacency(mask: DataFrame) -> DataFrame:
    """tile_id, y, x, ny, nx: neighbours among the mask's pixels, in all 8 directions."""
    near = shifted(mask.select(*PIXEL, F.col("y").alias("y0"), F.col("x").alias("x0")), NEIGHBOURS, "y0", "x0")
    return near.join(mask.select(*PIXEL), PIXEL).select("tile_id", F.col("y0").alias("y"), F.col("x0").alias("x"), F.col("y").alias("ny"), F.col("x").alias("nx"))


def pixel_classify(mask: DataFrame) -> DataFrame:
    """Adds degree and kind: endpoint (0 or 1 neighbours), interior (2), intersection."""
    degree = pixel_adjacency(mask).groupBy(*PIXEL).agg(F.count("*").alias("degree"))
    joined = mask.select(*PIXEL).join(degree, PIXEL, "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return joined.withColumn("kind", F.when(F.col("degree") <= 1, "endpoint").when(F.col("degree") == 2, "interior").otherwise("intersection"))


def pixel_id(tile: str = "tile_id", y: str = "y", x: str = "x", side: int = 1 << 20) -> Column:
    return (F.col(tile).cast("long") * side + F.col(y)) * side + F.col(x)


def pixel_place(pixel: Column, side: int = 1 << 20) -> Column:
    """The struct y, x of a pixel id."""
    return F.struct(F.pmod(F.floor(pixel / side), F.lit(side)).cast("int").alias("y"), F.pmod(pixel, F.lit(side)).cast("int").alias("x"))


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    return inside(shifted(mask.select(*PIXEL), offsets).select(*PIXEL), height, width).distinct()


def erode(mask: DataFrame, offsets: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    """Pixels all of whose neighbours at the offsets are set or lie outside the image."""
    held = shifted(mask.select(*PIXEL), [(-dy, -dx) for dy, dx in offsets]).select(*PIXEL).groupBy(*PIXEL).agg(F.count("*").alias("n"))
    need = sum(((F.col("y") + dy).between(0, height - 1) & (F.col("x") + dx).between(0, width - 1)).cast("int") for dy, dx in offsets)
    return held.join(mask.select(*PIXEL), PIXEL, "left_semi").where(F.col("n") >= need).select(*PIXEL)


def morph_skeleton(mask: DataFrame, height: int, width: int, most_rounds: int = 10_000) -> DataFrame:
    """Union of the image without its opening, over repeated erosions by a cross, until nothing is left.

    A full image never erodes, as outside pixels count as set; it has no
    skeleton and is returned empty instead of looping.
    """
    image, found = cut(mask.select(*PIXEL).distinct()), None
    for _ in range(most_rounds):
        eroded = cut(erode(image, CROSS, height, width))
        part = image.join(dilate(eroded, CROSS, height, width), PIXEL, "left_anti")
        found = part if found is None else found.unionByName(part)
        if eroded.isEmpty() or eroded.count() == image.count():
            break
        image = eroded
    return found.distinct()


def thinning_step(mask: DataFrame, second: bool = False) -> DataFrame:
    """One sub-iteration of two-pass parallel thinning: what it leaves of the mask.

    A pixel goes if it has 2 to 6 neighbours, one change from background to
    foreground around it, and the pass's two corner products are 0.
    """
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    near = pixel_adjacency(mask).withColumn("dy", F.col("ny") - F.col("y")).withColumn("dx", F.col("nx") - F.col("x"))
    p = {k: F.max(((F.col("dy") == dy) & (F.col("dx") == dx)).cast("int")).alias(f"p{k}") for k, (dy, dx) in enumerate(around)}
    rows = mask.select(*PIXEL).join(near.groupBy(*PIXEL).agg(*p.values()), PIXEL, "left").fillna(0, [f"p{k}" for k in range(8)])
    c = [F.col(f"p{k}") for k in range(8)]
    n = sum(c[1:], c[0])
    turns = sum(((c[k] == 0) & (c[(k + 1) % 8] == 1)).cast("int") for k in range(8))
    up, right, down, left = c[0], c[2], c[4], c[6]
    corners = (up * right * left == 0) & (up * down * left == 0) if second else (up * right * down == 0) & (right * down * left == 0)
    return rows.where(~((n >= 2) & (n <= 6) & (turns == 1) & corners)).select(*PIXEL)


def thinned(image: np.ndarray, second: bool) -> np.ndarray:
    """thinning_step() for images (tile, y, x) with a margin of one pixel of background."""
    height, width = image.shape[1] - 2, image.shape[2] - 2
    c = [image[:, 1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width].view(np.uint8) for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
    n = sum(c[1:], c[0].copy())
    turns = sum((c[(k + 1) % 8] > c[k]).view(np.uint8) for k in range(8))
    up, right, down, left = c[0], c[2], c[4], c[6]
    corners = (up & left & (right | down)) if second else (right & down & (up | left))
    found = image.copy()
    found[:, 1:-1, 1:-1] &= ~((n >= 2) & (n <= 6) & (turns == 1) & (corners == 0))
    return found


def skeletonize(mask: DataFrame, most_rounds: int = 10_000, cell: int = CELL) -> DataFrame:
    """Thinning until neither pass takes a pixel.

    A task thins a cell. What a cell's pixels become in HALO / 2 iterations follows from the HALO pixels around it; a cell
    without any around it is thinned to the end, the others meet again in the next round.
    """
    schema = StructType([*(StructField(c, mask.schema[c].dataType) for c in PIXEL), StructField("open", BooleanType())])

    def thin(group: pa.Table) -> pa.Table:
        group, odd = parted(group)
        odd = odd.append_column("open", pa.array([False] * len(odd))).cast(arrow)
        if not len(group):
            return odd
        own = column(group, "own")
        stack = Stack(group, 1)
        image, alone = stack.image(), bool(own.all())
        for _ in range(most_rounds if alone else HALO // 2):
            after = thinned(thinned(image, False), True)
            if (after == image).all():
                break
            image = after
        else:
            if alone:
                raise RuntimeError("thinning did not settle")
        pixels = stack.pixels(image & stack.image(own))
        return pa.concat_tables([pa.table([*pixels, np.full(len(pixels[0]), not alone)], names=[*PIXEL, "open"]).cast(arrow), odd])

    arrow = pa.schema([(f.name, pa.bool_() if f.name == "open" else _arrow(f)) for f in schema])
    now, done, n = mask.select(*PIXEL), [], None
    for _ in range(most_rounds):
        now = cut(grouped(now, HALO, cell=cell).applyInArrow(thin, schema))
        done.append(now.where("NOT open").select(*PIXEL))
        now = now.where("open").select(*PIXEL)
        left = now.count()
        if not left or left == n:
            break
        n = left
    else:
        raise RuntimeError("thinning did not settle")
    found = now
    for part in done:
        found = found.unionByName(part)
    return found


def _arrow(field: StructField) -> pa.DataType:
    return {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}[field.dataType.simpleString()]


def skeleton_nodes(skeleton: DataFrame) -> DataFrame:
    """id, tile_id, y, x, degree, is_endpoint of the skeleton's nodes: pixels with other than 2 neighbours, lone ones among them."""
    kinds = pixel_classify(skeleton).where("degree <> 2")
    return kinds.select(pixel_id().alias("id"), *PIXEL, "degree", (F.col("degree") <= 1).alias("is_endpoint"))


def mask_iou_dice(pred: DataFrame, target: DataFrame) -> DataFrame:
    """tile_id, iou, dice; a denominator of 0 counts as 1."""
    both = pred.select(*PIXEL, F.lit(1).alias("p")).join(target.select(*PIXEL, F.lit(1).alias("t")), PIXEL, "full")
    sums = both.groupBy("tile_id").agg(F.sum(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("i"), F.count("*").alias("u"), F.count("p").alias("np"), F.count("t").alias("nt"))
    return sums.select("tile_id", (F.col("i") / F.greatest("u", F.lit(1))).alias("iou"), (2 * F.col("i") / F.greatest(F.col("np") + F.col("nt"), F.lit(1))).alias("dice"))


def mask_relaxed_iou(pred: DataFrame, target: DataFrame, tolerance: int, height: int, width: int, cell: int = CELL) -> DataFrame:
    """tile_id, relaxed_iou: predicted pixels within the tolerance of the target, against the plain union; at most 1.

    A task counts the pixels of a cell, with the target's pixels up to the tolerance around it.
    """
    offsets = ellipse(tolerance)
    schema = StructType([StructField("tile_id", pred.schema["tile_id"].dataType), *(StructField(c, LongType()) for c in "iu")])
    arrow = pa.schema([("tile_id", _arrow(schema[0])), ("i", pa.int64()), ("u", pa.int64())])

    def counted(group: pa.Table) -> pa.Table:
        group, odd = parted(group)
        odd = odd.group_by("tile_id").aggregate([([], "count_all")])
        odd = pa.table([odd.column("tile_id"), pa.array([0] * len(odd)), odd.column("count_all")], names=["tile_id", "i", "u"]).cast(arrow)
        if not len(group):
            return odd
        own, wanted = column(group, "own"), column(group, "target")
        stack = Stack(group, tolerance)
        of_target, wide = stack.image(wanted), np.zeros(stack.shape, bool)
        rows, columns = stack.shape[1] - 2 * tolerance, stack.shape[2] - 2 * tolerance
        middle = slice(tolerance, tolerance + rows), slice(tolerance, tolerance + columns)
        for dy, dx in offsets:
            wide[:, tolerance + dy : tolerance + dy + rows, tolerance + dx : tolerance + dx + columns] |= of_target[:, middle[0], middle[1]]
        # Nothing is near the target outside the image.
        y, x = np.arange(stack.shape[1]) + stack.low[0], np.arange(stack.shape[2]) + stack.low[1]
        wide &= ((y >= 0) & (y < height))[:, None] & ((x >= 0) & (x < width))
        both = stack.image(own)
        hits = wide & stack.image(own & ~wanted)
        return pa.concat_tables([pa.table([stack.tiles, hits.sum((1, 2)), both.sum((1, 2))], names=["tile_id", "i", "u"]).cast(arrow), odd])

    every = pred.select(*PIXEL, F.lit(False).alias("target")).unionByName(target.select(*PIXEL, F.lit(True).alias("target")))
    sums = grouped(every, tolerance, "target", cell=cell).applyInArrow(counted, schema).groupBy("tile_id").agg(F.sum("i").alias("i"), F.sum("u").alias("u"))
    return sums.where("u > 0").select("tile_id", F.least(F.lit(1.0), F.col("i") / F.greatest("u", F.lit(1))).alias("relaxed_iou"))


def occlusion_recall(pred: DataFrame, target: DataFrame, occluded: DataFrame) -> DataFrame:
    """tile_id, recall: predicted share of the target's occluded pixels; 1 for a tile of the target without any."""
    hidden = target.select(*PIXEL).join(occluded.select(*PIXEL), PIXEL, "left_semi")
    found = hidden.join(pred.select(*PIXEL, F.lit(1).alias("p")), PIXEL, "left").groupBy("tile_id").agg(F.count("*").alias("n"), F.count("p").alias("k"))
    return target.select("tile_id").distinct().join(found, "tile_id", "left").select("tile_id", F.coalesce(F.col("k") / F.col("n"), F.lit(1.0)).alias("recall"))


def starts(size: int, patch: int, overlap: int) -> list[int]:
    """Where patches of one axis begin: every patch - overlap, and one that ends at the edge."""
    if patch <= overlap or size < patch:
        raise ValueError("a patch must be larger than the overlap and no larger than the image")
    found = list(range(0, size - patch + 1, patch - overlap))
    return found if found[-1] == size - patch else [*found, size - patch]


def extract_patches(mask: DataFrame, height: int, width: int, patch: int, overlap: int, *more: str) -> DataFrame:
    """Pixels of each patch in patch coordinates: tile_id, patch_id, y_start, x_start, y, x, and the columns named."""
    ys, xs = (F.array(*(F.lit(s) for s in starts(n, patch, overlap))) for n in (height, width))
    rows = mask.select(*PIXEL, *more, F.explode(ys).alias("y_start")).where(F.col("y").between(F.col("y_start"), F.col("y_start") + patch - 1))
    rows = rows.withColumn("x_start", F.explode(xs)).where(F.col("x").between(F.col("x_start"), F.col("x_start") + patch - 1))
    return rows.select("tile_id", F.format_string("patch_y%d_x%d", "y_start", "x_start").alias("patch_id"), "y_start", "x_start", (F.col("y") - F.col("y_start")).alias("y"), (F.col("x") - F.col("x_start")).alias("x"), *more)


def stitch_patches(patches: DataFrame, height: int, width: int, patch: int, overlap: int) -> DataFrame:
    """tile_id, y, x, value: the mean over the patches that cover a pixel of their values (255 where set, 0 elsewhere)."""
    ys, xs = (F.array(*(F.lit(s) for s in starts(n, patch, overlap))) for n in (height, width))
    cover = F.size(F.filter(ys, lambda s: F.col("gy").between(s, s + patch - 1))) * F.size(F.filter(xs, lambda s: F.col("gx").between(s, s + patch - 1)))
    placed = patches.select("tile_id", (F.col("y") + F.col("y_start")).alias("gy"), (F.col("x") + F.col("x_start")).alias("gx"))
    return placed.groupBy("tile_id", "gy", "gx").agg(F.count("*").alias("n")).select("tile_id", F.col("gy").alias("y"), F.col("gx").alias("x"), (255.0 * F.col("n") / F.greatest(cover, F.lit(1))).alias("value"))


def punch_hole(mask: DataFrame, cy: int, cx: int, radius: int) -> DataFrame:
    return mask.select(*PIXEL).where(F.pow(F.col("y") - cy, 2) + F.pow(F.col("x") - cx, 2) > radius * radius)


def flip_rotate(mask: DataFrame, height: int, width: int) -> DataFrame:
    """The mask flipped left-right, flipped top-bottom and turned a quarter to the left, told apart by `variant`."""
    ways = F.array(
        F.struct(F.lit("horizontal").alias("variant"), F.col("y").alias("y"), (width - 1 - F.col("x")).alias("x")),
        F.struct(F.lit("vertical").alias("variant"), (height - 1 - F.col("y")).alias("y"), F.col("x").alias("x")),
        F.struct(F.lit("rot90").alias("variant"), (width - 1 - F.col("x")).alias("y"), F.col("y").alias("x")),
    )
    return mask.select("tile_id", F.explode(ways).alias("w")).select("tile_id", "w.*")


def overlay_roads(image: DataFrame, mask: DataFrame, colour: tuple[int, int, int] = (200, 200, 200), share: float = 0.6) -> DataFrame:
    """image (tile_id, y, x, r, g, b) with the colour blended in on road pixels, truncated."""
    roads = mask.select(*PIXEL, F.lit(True).alias("road"))
    blend = [F.when(F.col("road"), F.floor(F.col(c) * (1 - share) + v * share)).otherwise(F.col(c)).cast("int").alias(c) for c, v in zip("rgb", colour)]
    return image.join(roads, PIXEL, "left").select(*PIXEL, *blend)


def occlusion_mask(a: DataFrame, b: DataFrame, least: float = 15.0) -> DataFrame:
    """Pixels whose mean absolute difference over the channels is above `least`."""
    joined = a.alias("a").join(b.alias("b"), PIXEL)
    diff = sum(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "rgb") / 3
    return joined.where(diff > least).select(*PIXEL)


def grid(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """All pixels of tiles (tile_id) of one size."""
    rows = tiles.select("tile_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return rows.select("tile_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))


def rasterize_ways(points: DataFrame, height: int, width: int, thickness: int = 5) -> DataFrame:
    """Pixels within thickness / 2 of the ways (tile_id, way_id, pos, y, x): each from one point to the next by pos, then y, x.

    A segment only looks at the pixels of its bounding box, so the rows follow
    the length of the ways; pixels outside the image are left out.
    """
    half = thickness / 2
    along = Window.partitionBy("tile_id", "way_id").orderBy("pos", "y", "x")
    ends = points.select("tile_id", F.col("y").cast("double").alias("ya"), F.col("x").cast("double").alias("xa"), F.lead("y").over(along).cast("double").alias("yb"), F.lead("x").over(along).cast("double").alias("xb")).where("yb IS NOT NULL")

    def span(a: str, b: str, most: int) -> Column:
        low = F.greatest(F.lit(0), F.floor(F.least(a, b) - half)).cast("int")
        high = F.least(F.lit(most), F.ceil(F.greatest(a, b) + half)).cast("int")
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    cells = ends.withColumn("y", span("ya", "yb", height - 1)).withColumn("x", span("xa", "xb", width - 1))
    dy, dx = F.col("yb") - F.col("ya"), F.col("xb") - F.col("xa")
    size = dy * dy + dx * dx
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("y") - F.col("ya")) * dy + (F.col("x") - F.col("xa")) * dx) / F.greatest(size, F.lit(1e-9)))))
    near = F.pow(F.col("y") - (F.col("ya") + t * dy), 2) + F.pow(F.col("x") - (F.col("xa") + t * dx), 2) <= half * half
    return cells.where(near).select(*PIXEL).distinct()


def synthetic_road_mask(tiles: DataFrame, height: int = 64, width: int = 64, thickness: int = 5) -> DataFrame:
    """A grid of roads on each of tiles (tile_id): rows at 25, 50 and 75 %, columns at 20, 50 and 80 %, two pixels wider than a bent diagonal."""
    #: The bends of the diagonal, as shares of height and width.
    wide = (thickness + 2) / 2
    rows = [int(height * s) for s in (0.25, 0.5, 0.75)]
    columns = [int(width * s) for s in (0.2, 0.5, 0.8)]
    bends = [(int(height * b), int(width * a)) for a, b in ((0.1, 0.1), (0.4, 0.35), (0.7, 0.85))]
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    near = F.lit(False)
    for r in rows:
        near = near | (F.abs(y - r) <= wide)
    for c in columns:
        near = near | (F.abs(x - c) <= wide)
    for (ya, xa), (yb, xb) in zip(bends, bends[1:]):
        size = float((yb - ya) ** 2 + (xb - xa) ** 2)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((y - ya) * (yb - ya) + (x - xa) * (xb - xa)) / size))
        near = near | (F.sqrt(F.pow(y - (ya + t * (yb - ya)), 2) + F.pow(x - (xa + t * (xb - xa)), 2)) <= thickness / 2)
    return grid(tiles.select("tile_id").distinct(), height, width).where(near)


def normalise(image: DataFrame) -> DataFrame:
    """image (tile_id, y, x, r, g, b) with channels from 0 to 1."""
    return image.select(*PIXEL, *((F.col(c) / 255.0).alias(c) for c in "rgb"))


def swap_channels(image: DataFrame) -> DataFrame:
    """Red and blue change places."""
    return image.select(*PIXEL, F.col("b").alias("r"), "g", F.col("r").alias("b"))


def gray_to_rgb(mask: DataFrame, value: int = 255) -> DataFrame:
    """Mask pixels as image pixels of equal channels."""
    return mask.select(*PIXEL, *(F.lit(value).alias(c) for c in "rgb"))


def side_by_side(images: list[DataFrame], width: int) -> DataFrame:
    """Images of one height and width as one, the first on the left."""
    found = None
    for k, image in enumerate(images):
        moved = image.withColumn("x", (F.col("x") + k * width).cast("int"))
        found = moved if found is None else found.unionByName(moved)
    return found


def gaussian_line(size: int, sigma: float = 0.0) -> list[float]:
    """Weights of an odd number of places that add up to 1; without a sigma above 0 it follows from the size."""
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    line = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [w / sum(line) for w in line]


def reflected_blur(images: np.ndarray, axis: int, weights: list[float]) -> np.ndarray:
    """One pass along an axis: terms are added in the order of the weights; at the border images are reflected without repeating their edge."""
    reach, n = len(weights) // 2, images.shape[axis]
    images = np.moveaxis(images, axis, 0)
    wide = np.pad(images, [(reach, reach), *[(0, 0)] * (images.ndim - 1)], mode="reflect") if reach else images
    found = np.zeros_like(images)
    for k, w in enumerate(weights):
        found += wide[k : k + n] * w
    return np.moveaxis(found, 0, axis)


def check_blur(size: int, *sides: int) -> None:
    if size // 2 >= min(sides):
        raise ValueError(f"a blur of {size} places needs images of more than {size // 2}")


def _blurred(pixels: DataFrame, columns: list[str], key: list[str | Column], axes: str, shape: tuple[int, int], weights: list[float]) -> DataFrame:
    """Passes along axes for groups by key: whole images, or blocks of their lines, full along the one axis. shape: of an image; a block begins where its pixels do."""
    schema = StructType([*(pixels.schema[c] for c in PIXEL), *(StructField(c, DoubleType()) for c in columns)])

    def blur(group: pa.Table) -> pa.Table:
        y, x = column(group, "y").astype(np.int64), column(group, "x").astype(np.int64)
        y, x = y - (0 if "y" in axes else y.min()), x - (0 if "x" in axes else x.min())
        size = shape[0] if "y" in axes else int(y.max()) + 1, shape[1] if "x" in axes else int(x.max()) + 1
        images, missing = np.zeros((len(columns), *size)), np.ones((len(columns), *size))
        for k, c in enumerate(columns):
            value = group.column(c)
            images[k, y, x] = value.cast(pa.float64()).fill_null(0.0).to_numpy()
            missing[k, y, x] = value.is_null().to_numpy()
        some = bool(missing.any())
        for axis in axes:
            images = reflected_blur(images, "yx".index(axis) + 1, weights)
            missing = reflected_blur(missing, "yx".index(axis) + 1, weights) if some else missing
        # A term without a value leaves none to the sum.
        done = [pa.array(images[k, y, x], mask=missing[k, y, x] > 0) for k in range(len(columns))]
        return pa.table([*(group.column(c) for c in PIXEL), *done], names=[*PIXEL, *columns])

    return pixels.groupBy(*key).applyInArrow(blur, schema)


def gaussian_blur(pixels: DataFrame, columns: list[str], height: int, width: int, size: int = 5, sigma: float = 1.0) -> DataFrame:
    """pixels of full images with the columns blurred; at the border the image is reflected without repeating its edge.

    Two passes of `size` terms a pixel, down the columns and along the rows: together in an image's task, or, where an image has more than
    IMAGE_PIXELS, each by blocks of lines. Images have to be larger than half of the size.
    """
    weights = gaussian_line(size, sigma)
    check_blur(size, height, width)
    pixels = pixels.select(*PIXEL, *columns)
    if height * width <= IMAGE_PIXELS:
        return _blurred(pixels, columns, ["tile_id"], "yx", (height, width), weights)
    for axis, other, n in (("y", "x", height), ("x", "y", width)):
        pixels = _blurred(pixels, columns, ["tile_id", F.floor(F.col(other) / max(1, IMAGE_PIXELS // n)).alias("block")], axis, (height, width), weights)
    return pixels


def resize(pixels: DataFrame, columns: list[str], height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Full images in another size by cubic convolution (a = -0.75), pixel centres aligned, edges repeated.

    Which old pixels a new one sees depends on its place only; these weights
    are one small table of new_height and new_width rows, joined by place.
    """

    def weights(n: int, m: int) -> list[tuple[int, int, float]]:
        a, found = -0.75, {}
        for k in range(m):
            at = (k + 0.5) * n / m - 0.5
            for j in range(math.floor(at) - 1, math.floor(at) + 3):
                d = abs(at - j)
                w = ((a + 2) * d - (a + 3)) * d * d + 1 if d <= 1 else ((a * d - 5 * a) * d + 8 * a) * d - 4 * a if d < 2 else 0.0
                place = min(max(j, 0), n - 1)
                found[place, k] = found.get((place, k), 0.0) + w
        return [(j, k, w) for (j, k), w in sorted(found.items())]

    spark = pixels.sparkSession
    found = pixels
    for axis, n, m in (("y", height, new_height), ("x", width, new_width)):
        other = "x" if axis == "y" else "y"
        table = F.broadcast(spark.createDataFrame(weights(n, m), f"{axis} int, new int, weight double"))
        found = found.join(table, axis).groupBy("tile_id", other, F.col("new").alias(axis)).agg(*(F.sum(F.col(c) * F.col("weight")).alias(c) for c in columns))
    return found.select(*PIXEL, *columns)


def _chance(name: str, seed: int) -> Column:
    """From 0 up to 1, drawn by MD5 of the tile, the seed and a name."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", "tile_id", F.lit(str(seed)), F.lit(name))), 1, 8), 16, 10).cast("long") / float(1 << 32)


def augment(image: DataFrame, height: int, width: int, seed: int = 42, flip: float = 0.5, turn: float = 0.5, brightness: float = 0.3, most: float = 0.2) -> DataFrame:
    """Training variants of square tiles (tile_id, y, x and channels r, g, b where present): each tile by its own draws.

    With chance `flip` each, left-right and top-bottom change; with chance
    `turn` the tile is turned to the left by 0 to 3 quarters; with chance
    `brightness` channels are scaled by 1 - most to 1 + most and then moved by up to
    most * 255 to either side. Masks go with their image under the same seed.
    """
    y, x = F.col("y"), F.col("x")
    x = F.when(_chance("horizontal", seed) < flip, width - 1 - x).otherwise(x)
    y = F.when(_chance("vertical", seed) < flip, height - 1 - y).otherwise(y)
    quarters = F.when(_chance("turn", seed) < turn, F.floor(4 * _chance("quarters", seed))).otherwise(0)
    turned_y = F.when(quarters == 1, width - 1 - x).when(quarters == 2, height - 1 - y).when(quarters == 3, x).otherwise(y)
    turned_x = F.when(quarters == 1, y).when(quarters == 2, width - 1 - x).when(quarters == 3, height - 1 - y).otherwise(x)
    bright = _chance("bright", seed) < brightness
    scale, shift = 1 + most * (2 * _chance("scale", seed) - 1), 255 * most * (2 * _chance("shift", seed) - 1)
    colours = [F.when(bright, F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col(c) * scale + shift)))).otherwise(F.col(c)).cast("int").alias(c) for c in "rgb" if c in image.columns]
    return image.select("tile_id", turned_y.cast("int").alias("y"), turned_x.cast("int").alias("x"), *colours)
