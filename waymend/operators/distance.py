"""Distances of pixels to a mask, one transform for every tolerance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import PIXEL


def squared_distances(mask: np.ndarray, slack: float = 0.0) -> np.ndarray:
    """For each pixel of an image the least (|dx| - slack)^2 + dy^2 to a set pixel, infinite in an empty image; |dx| below slack counts 0.

    Two passes: the nearest set pixel of each row on either side, then the least over the rows, until no farther row can be nearer.
    """
    height, width = mask.shape
    x = np.arange(width)
    left = np.maximum.accumulate(np.where(mask, x, -np.inf), axis=1)
    right = np.minimum.accumulate(np.where(mask, x, np.inf)[:, ::-1], axis=1)[:, ::-1]
    along = np.maximum(np.minimum(x - left, right - x) - slack, 0.0) ** 2
    best = along.copy()
    for dy in range(1, height):
        if dy * dy >= best.max():
            break
        best[dy:] = np.minimum(best[dy:], along[:-dy] + dy * dy)
        best[:-dy] = np.minimum(best[:-dy], along[dy:] + dy * dy)
    return best


def distance_to(pixels: DataFrame, mask: DataFrame, height: int, width: int, slack: float = 0.0) -> DataFrame:
    """pixels (tile_id, y, x) with d2, the squared distance to the mask's nearest pixel of the same tile; infinite for a tile without any.

    A tile of both tables is one task's group: height * width pixels of each at most.
    """

    def look(key: tuple, asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width), bool)
        image[given["y"].to_numpy(), given["x"].to_numpy()] = True
        return asked.assign(d2=squared_distances(image, slack)[asked["y"].to_numpy(), asked["x"].to_numpy()])

    asked, given = pixels.select(*PIXEL).distinct(), mask.select(F.col("tile_id").alias("of"), "y", "x").distinct()
    return asked.groupBy("tile_id").cogroup(given.groupBy("of")).applyInPandas(look, "tile_id int, y int, x int, d2 double")


def relaxed_ious(pred: DataFrame, target: DataFrame, tolerances: list[int], height: int, width: int) -> DataFrame:
    """tile_id, tolerance, relaxed_iou for every tolerance from one transform; the same as dilating the target by the ellipse of each.

    The ellipse of radius r holds (dy, dx) up to the rounded half-width of the circle: where dy^2 + (|dx| - 1/2)^2 is at most r^2.
    """
    far = distance_to(pred, target, height, width, 0.5)
    level = F.explode(F.array(*map(F.lit, tolerances))).alias("tolerance")
    hits = far.groupBy("tile_id").agg(*(F.count(F.when(F.col("d2") <= t * t, 1)).alias(f"hits_{t}") for t in tolerances))
    union = pred.select(*PIXEL).union(target.select(*PIXEL)).distinct().groupBy("tile_id").agg(F.count("*").alias("u"))
    joined = union.join(hits, "tile_id", "left").select("*", level)
    hit = F.coalesce(*(F.when(F.col("tolerance") == t, F.col(f"hits_{t}")) for t in tolerances), F.lit(0))
    return joined.select("tile_id", "tolerance", F.least(F.lit(1.0), hit / F.greatest("u", F.lit(1))).alias("relaxed_iou"))
