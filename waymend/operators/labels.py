"""Components of masks, labelled cell by cell.

An image is cut into square cells. Each cell's components are found in its own
task; only pixels at the cells' borders meet those of other cells, and only
the labels they link go through the rounds of a distributed labelling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import connected_components
from .raster import NEIGHBOURS, PIXEL, pixel_id, shifted

CELL = 256


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links between them, the least node that each one reaches."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pixels of a cell (tile_id, y, x, node) with the least node of their component; nodes are in order of y and x."""
    pdf = pdf.drop_duplicates(["y", "x"]).sort_values(["y", "x"], kind="stable")
    y, x = pdf["y"].to_numpy().astype(np.int64), pdf["x"].to_numpy().astype(np.int64)
    y, x = y - y.min(), x - x.min()
    width = int(x.max()) + 2
    at = np.full((int(y.max()) + 2, width + 1), -1, np.int64)
    at[y, x + 1] = np.arange(len(y))
    near = np.stack([at[y + dy, x + 1 + dx] for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    _, a = np.nonzero(near >= 0)
    b = near[near >= 0]
    return pdf[PIXEL].assign(part=pdf["node"].to_numpy()[least_labels(len(y), a, b)])


def cell_labels(mask: DataFrame, cell: int = CELL) -> DataFrame:
    """tile_id, y, x, part: the least pixel id of each pixel's component within its cell. Duplicate pixels count once."""
    cells = mask.select(*PIXEL, pixel_id().alias("node"), F.floor(F.col("y") / cell).alias("cy"), F.floor(F.col("x") / cell).alias("cx"))
    return cells.groupBy("tile_id", "cy", "cx").applyInPandas(_cell, "tile_id int, y int, x int, part long")


def pixel_components(mask: DataFrame, cell: int = CELL) -> DataFrame:
    """Adds label, the least pixel id of each 8-connected component. A cell's pixels, cell * cell at most, are one task's group."""
    parts = cut(cell_labels(mask.select("tile_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")), cell))
    at_border = F.expr(f"pmod(y, {cell}) IN (0, {cell - 1}) OR pmod(x, {cell}) IN (0, {cell - 1})")
    border = cut(parts.where(at_border))
    near = shifted(border, NEIGHBOURS, F.col("y").alias("y0"), F.col("x").alias("x0"), "part").where(F.expr(f"floor(y / {cell}) <> floor(y0 / {cell}) OR floor(x / {cell}) <> floor(x0 / {cell})"))
    links = cut(near.join(border.withColumnRenamed("part", "other"), PIXEL).where("part < other").select(F.col("part").alias("u"), F.col("other").alias("v")).distinct())
    if links.isEmpty():
        return parts.withColumnRenamed("part", "label")
    # A part's label names its cell, so that no label of the whole is a key of more than a cell's pixels.
    named = connected_components(links).withColumnRenamed("node", "part")
    return parts.join(named, "part", "left").select(*PIXEL, F.coalesce("component", "part").alias("label"))


def component_area_filter(mask: DataFrame, least: int = 15) -> DataFrame:
    """Pixels of components of at least `least` pixels."""
    labelled = cut(pixel_components(mask))
    small = labelled.groupBy("label").count().where(F.col("count") < least).select("label")
    # Small components are many but hold few pixels each; large ones would be hot keys.
    return labelled.join(small, "label", "left_anti").select(*PIXEL)
