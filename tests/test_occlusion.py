"""Shapes against their definition pixel by pixel, and images under them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymend.operators import occlusion, raster


def in_polygon(y, x, corners):
    """By parity of the edges that a line to the left crosses; edges are drawn by the nearest pixel of each row."""
    inside = False
    for (ya, xa), (yb, xb) in zip(corners, corners[1:] + corners[:1]):
        low, high = min(ya, yb), max(ya, yb)
        if low <= y <= high:
            if ya == yb:
                if min(xa, xb) <= x <= max(xa, xb):
                    return True
                continue
            at = xa + (y - ya) * (xb - xa) / (yb - ya)
            if x == np.floor(at + 0.5) or (y < high and x == at):
                return True
            inside ^= y < high and at <= x
    return inside


def test_polygons_by_parity(spark):
    rng = random.Random(4)
    shapes = {(t, k): [(rng.randrange(-8, 30), rng.randrange(-8, 34)) for _ in range(rng.randrange(3, 7))] for t in (0, 3) for k in range(6)}
    shapes |= {(5, 0): [(4, 4)] * 3, (5, 1): [(2, 3), (2, 9), (2, 5)], (5, 2): [(0, 0), (0, 10), (10, 10), (10, 0)], (5, 3): [(-9, -9), (-9, -4), (-4, -4)]}
    rows = [(t, k, at, y, x) for (t, k), corners in shapes.items() for at, (y, x) in enumerate(corners)]
    got = {tuple(r) for r in occlusion.filled_polygons(spark.createDataFrame(rows, "tile_id int, k int, at int, y int, x int").repartition(3), 24, 28).collect()}
    assert got == {(t, k, y, x) for (t, k), corners in shapes.items() for y in range(24) for x in range(28) if in_polygon(y, x, corners)}


def test_ellipses(spark):
    rows = [(0, 0, 10, 12, 6, 3, 0), (0, 1, 2, 3, 9, 5, 30), (1, 0, 29, 20, 4, 4, 77), (1, 1, -50, 0, 4, 4, 0)]
    got = {tuple(r) for r in occlusion.filled_ellipses(spark.createDataFrame(rows, "tile_id int, k int, cx int, cy int, rx int, ry int, turn int"), 24, 30).collect()}
    want = set()
    for t, k, cx, cy, rx, ry, turn in rows:
        a = np.radians(turn)
        want |= {(t, k, y, x) for y in range(24) for x in range(30) if (((x - cx) * np.cos(a) + (y - cy) * np.sin(a)) / rx) ** 2 + (((y - cy) * np.cos(a) - (x - cx) * np.sin(a)) / ry) ** 2 <= 1}
    assert got == want


def test_images_under_shapes(spark):
    tiles = spark.createDataFrame([(0,), (9,)], "tile_id int")
    gray = raster.grid(tiles, 56, 64).withColumns({c: F.lit(128) for c in "rgb"})
    one = sorted(map(tuple, occlusion.occlude(gray.repartition(3), 56, 64, 2, 1, 1).collect()))
    assert one == sorted(map(tuple, occlusion.occlude(gray.repartition(7), 56, 64, 2, 1, 1).collect()))
    assert len(one) == 2 * 56 * 64 and all(0 <= c <= 255 for r in one for c in r[3:]) and any(r[3:] != (128, 128, 128) for r in one)
    assert one != sorted(map(tuple, occlusion.occlude(gray, 56, 64, 2, 1, 1, seed=7).collect()))
    # Shadows darken, clouds lighten, and each by no more than its numbers allow.
    dark = occlusion.occlude(gray, 56, 64, 1, 0, 0).collect()
    light = {r.tile_id: r.light for r in occlusion.shapes(tiles, "shadow", 1, 56, 64).collect()}
    assert all(r.r == r.g == r.b and 128 * light[r.tile_id] - 1 <= r.r <= 128 for r in dark) and min(r.r for r in dark) < 100
    assert all(r.r >= 128 for r in occlusion.occlude(gray, 56, 64, 0, 0, 1).collect())
    assert occlusion.occlude(gray, 56, 64, 0, 0, 0).exceptAll(gray).isEmpty()
    green = occlusion.occlude(gray, 56, 64, 0, 1, 0).collect()
    assert min(r.r for r in green) < 60 and all(r.g >= r.r for r in green)
    with pytest.raises(ValueError):
        occlusion.occlude(gray.where("y < 20 AND x < 20"), 20, 20)


def test_shapes_keep_their_ranges(spark):
    tiles = spark.range(300).select(F.col("id").cast("int").alias("tile_id"))
    shadows = occlusion.shapes(tiles, "shadow", 2, 512, 400).collect()
    assert {r.corners for r in shadows} == {3, 4, 5, 6} and all(20 <= r.radius < 100 and 0.25 <= r.light < 0.55 and 0 <= r.cx < 400 and 0 <= r.cy < 512 for r in shadows) and max(r.radius for r in shadows) > 90
    canopies = occlusion.shapes(tiles, "canopy", 1, 512, 400).collect()
    assert all(25 <= r.rx < 60 and 25 <= r.ry < 60 and 0 <= r.turn < 180 and 90 <= r.green < 130 for r in canopies)
    clouds = occlusion.shapes(tiles, "cloud", 1, 512, 400).collect()
    assert all(40 <= r.rx < 133 and r.rx == r.ry and 0.6 <= r.opacity < 0.9 for r in clouds)


def test_covers_are_laid_in_one_task_or_by_joins(spark, monkeypatch):
    """Both ways give the same rows, with missing pixels and channels; images in tasks need no join of all pixels and few stages."""
    tiles = spark.createDataFrame([(0,), (2,), (7,)], "tile_id int")
    image = raster.grid(tiles, 60, 57).where("(y * 7 + x) % 11 <> 0").withColumns({"r": (F.col("y") * 3).cast("int"), "g": F.when(F.col("x") != 5, F.col("x")), "b": F.lit(200)})
    one = occlusion.occlude(image, 60, 57)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapCoGroups") == 1
    whole = sorted(map(tuple, one.collect()))
    monkeypatch.setattr(raster, "IMAGE_PIXELS", 500)
    assert whole == sorted(map(tuple, occlusion.occlude(image, 60, 57).collect())) and len(whole) == image.count()
    assert whole != sorted(map(tuple, image.collect()))


def test_variants_of_occluded_images(spark):
    """Variants are the occluded images, turned and brightened, in the same single pass over the pixels."""
    tiles = spark.createDataFrame([(k,) for k in range(6)], "tile_id int")
    image = raster.grid(tiles, 64, 64).withColumns({c: (F.col("y") * 2 + F.col("x")).cast("int") for c in "rgb"})
    found = occlusion.occluded_variants(image, 64, 64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapCoGroups") == 1
    want = raster.augment(spark.createDataFrame(occlusion.occlude(image, 64, 64, 2, 2, 1).collect(), "tile_id int, y int, x int, r int, g int, b int"), 64, 64, 42)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
