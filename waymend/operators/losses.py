"""Segmentation losses as aggregates over dense pixel relations (tile_id, y, x, p, t)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import PIXEL

#: The 3x3 kernels, as (dy, dx, weight).
SOBEL_X = [(-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)]
SOBEL_Y = [(-1, -1, -1), (-1, 0, -2), (-1, 1, -1), (1, -1, 1), (1, 0, 2), (1, 1, 1)]
LAPLACIAN = [(-1, 0, 1), (0, -1, 1), (0, 0, -4), (0, 1, 1), (1, 0, 1)]
#: The weights of dice, cross-entropy, boundary and connectivity in the composite.
WEIGHTS = (1.0, 0.5, 0.2, 0.1)


def convolve(pixels: DataFrame, columns: list[str], kernels: dict[str, list[tuple[int, int, int]]]) -> DataFrame:
    """pixels with a column `<kernel>_<column>` for each: weighted sums of the neighbours, zero outside.

    Each pixel sends its weighted value to the pixels that see it, and the
    parts are summed: one shuffle for all kernels.
    """
    offsets = sorted({(dy, dx) for k in kernels.values() for dy, dx, _ in k})
    weight = {(name, dy, dx): w for name, k in kernels.items() for dy, dx, w in k}
    parts = F.array(*(F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), *(F.lit(float(weight.get((n, dy, dx), 0))).alias(n) for n in kernels)) for dy, dx in offsets))
    sent = pixels.select(*PIXEL, *columns, F.explode(parts).alias("k")).select(
        "tile_id", (F.col("y") + F.col("k.dy")).alias("y"), (F.col("x") + F.col("k.dx")).alias("x"), *((F.col(c) * F.col(f"k.{n}")).alias(f"{n}_{c}") for n in kernels for c in columns)
    )
    sums = sent.groupBy(*PIXEL).agg(*(F.sum(f"{n}_{c}").alias(f"{n}_{c}") for n in kernels for c in columns))
    return pixels.join(sums, PIXEL, "left")


def sobel_edges(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """pixels with edge_<column>: the gradient's size, 1e-6 under the root."""
    found = convolve(pixels, columns, {"gx": SOBEL_X, "gy": SOBEL_Y})
    for c in columns:
        found = found.withColumn(f"edge_{c}", F.sqrt(F.pow(f"gx_{c}", 2) + F.pow(f"gy_{c}", 2) + 1e-6))
    return found.drop(*(f"g{a}_{c}" for a in "xy" for c in columns))


def dice_loss(pixels: DataFrame, smooth: float = 1.0) -> DataFrame:
    both = F.sum(F.col("p") * F.col("t"))
    return pixels.agg((1 - (2 * both + smooth) / (F.sum("p") + F.sum("t") + smooth)).alias("dice_loss"))


def bce_loss(pixels: DataFrame) -> DataFrame:
    z = F.ln(F.col("p") / (1 - F.col("p")))
    return pixels.agg(F.avg(F.greatest(z, F.lit(0.0)) - z * F.col("t") + F.log1p(F.exp(-F.abs(z)))).alias("bce_loss"))


def boundary_loss(pixels: DataFrame) -> DataFrame:
    return sobel_edges(pixels, ["p", "t"]).agg(F.avg(F.abs(F.col("edge_p") - F.col("edge_t"))).alias("boundary_loss"))


def connectivity_loss(pixels: DataFrame) -> DataFrame:
    found = convolve(pixels, ["p", "t"], {"lap": LAPLACIAN})
    return found.agg(F.avg(F.abs("lap_p") * (F.abs("lap_t") < 0.5).cast("double") * F.col("t")).alias("connectivity_loss"))


def composite_loss(pixels: DataFrame, weights: tuple[float, float, float, float] = WEIGHTS) -> DataFrame:
    """One row: the four losses and their weighted sum, total_loss."""
    parts = dice_loss(pixels).crossJoin(bce_loss(pixels)).crossJoin(boundary_loss(pixels)).crossJoin(connectivity_loss(pixels))
    names = ("dice_loss", "bce_loss", "boundary_loss", "connectivity_loss")
    return parts.select(*names, sum(F.col(n) * w for n, w in zip(names, weights)).alias("total_loss"))
