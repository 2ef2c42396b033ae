"""Square cells of masks with the pixels around them, so that tasks look at neighbourhoods without a join.

A pixel goes to its own cell and to those that it is at most `halo` away from.
Cells are moved by the halo, so that images of up to CELL - 2 * halo pixels a
side are one cell and nothing is copied. A task's group is a cell of up to
TILES neighbouring tiles, which are worked out side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

CELL, TILES = 256, 16
PLACE = ["tile_id", "y", "x"]


def grouped(pixels: DataFrame, halo: int, *more: str, cell: int = CELL) -> GroupedData:
    """Groups of tile_id, y, x, own and the columns named; own: the pixel is of the cell itself. Pixels without a place stand in one cell."""
    at = lambda c, by: F.floor((F.coalesce(c, F.lit(0)) + by) / cell)
    near = pixels.select(*PLACE, *more, F.explode(F.sequence(at("y", 0), at("y", 2 * halo))).alias("cy"))
    near = near.select("*", F.explode(F.sequence(at("x", 0), at("x", 2 * halo))).alias("cx"))
    near = near.withColumn("own", (F.col("cy") == at("y", halo)) & (F.col("cx") == at("x", halo)))
    return near.groupBy(F.floor(F.col("tile_id") / TILES).alias("block"), "cy", "cx")


def parted(group: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The pixels that have a place, and the places of the cell's own that are null in part, each once."""
    if not any(group.column(c).null_count for c in PLACE):
        return group, group.slice(0, 0).select(PLACE)
    valid = pc.and_(pc.and_(*(pc.is_valid(group.column(c)) for c in PLACE[:2])), pc.is_valid(group.column(PLACE[2])))
    return group.filter(valid), group.filter(pc.and_(pc.invert(valid), group.column("own"))).select(PLACE).group_by(PLACE).aggregate([])


def column(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).to_numpy()


class Stack:
    """The pixels of a group as images of its tiles, one above the other, with a margin of background around."""

    def __init__(self, group: pa.Table, margin: int):
        self.tiles, self.tile = np.unique(column(group, "tile_id"), return_inverse=True)
        y, x = column(group, "y").astype(np.int64), column(group, "x").astype(np.int64)
        self.low = y.min() - margin, x.min() - margin
        self.y, self.x = y - self.low[0], x - self.low[1]
        self.shape = len(self.tiles), int(self.y.max()) + margin + 1, int(self.x.max()) + margin + 1

    def image(self, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
        found = np.zeros(self.shape, bool)
        found[self.tile[chosen], self.y[chosen], self.x[chosen]] = True
        return found

    def pixels(self, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tile, y, x = np.nonzero(image)
        return self.tiles[tile], y + self.low[0], x + self.low[1]
