"""Distances, epochs, ways over tiles and terrains against their definitions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymend.operators import distance, epochs, raster, ways
from waymend.sources import synthetic

PIXELS = "tile_id int, y int, x int"


@pytest.mark.parametrize("share", [0.0, 0.01, 0.2])
@pytest.mark.parametrize("slack", [0.0, 0.5])
def test_transform_is_exact(share, slack):
    rng = np.random.default_rng(5)
    mask = rng.random((19, 27)) < share
    points = np.argwhere(mask)
    far = lambda y, x: min((max(abs(x - b) - slack, 0) ** 2 + (y - a) ** 2 for a, b in points), default=math.inf)
    assert distance.squared_distances(mask, slack).tolist() == [[far(y, x) for x in range(27)] for y in range(19)]


def test_every_tolerance_equals_its_dilation(spark):
    rng = np.random.default_rng(8)
    make = lambda share, tiles: spark.createDataFrame([(t, int(y), int(x)) for t in tiles for y, x in np.argwhere(rng.random((30, 34)) < share)] + [(90 + len(tiles), 3, 3)], PIXELS)
    pred, target = make(0.05, (0, 1, 2)), make(0.01, (0, 1))
    got = {(r.tile_id, r.tolerance): r.relaxed_iou for r in distance.relaxed_ious(pred, target, [0, 1, 3, 6, 11], 30, 34).collect()}
    want = {(r.tile_id, t): r.relaxed_iou for t in (0, 1, 3, 6, 11) for r in raster.mask_relaxed_iou(pred, target, t, 30, 34).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 101])
def test_every_epoch_is_a_permutation(spark, n):
    rows = spark.range(n).select(F.format_string("key %05d", "id").alias("key")).repartition(3)
    got = epochs.epoch_batches(rows, "key", 3, 10).collect()
    for epoch in range(3):
        mine = [r for r in got if r.epoch == epoch]
        assert sorted(10 * r.batch + r.place for r in mine) == list(range(n)) and len({r.key for r in mine}) == n
    if n > 60:
        orders = {tuple(r.key for r in sorted((r for r in got if r.epoch == e), key=lambda r: (r.batch, r.place))) for e in range(3)}
        assert len(orders) == 3 and tuple(sorted(r.key for r in got if r.epoch == 0)) not in orders
        assert sorted(map(tuple, got)) == sorted(map(tuple, epochs.epoch_batches(rows.repartition(5), "key", 3, 10).collect()))


def test_epochs_of_equal_keys_and_of_nothing(spark):
    rows = spark.createDataFrame([("a",)] * 20 + [("b",)], "key string")
    assert Counter(r.key for r in epochs.epoch_batches(rows, "key", 2, 4).collect()) == {"a": 40, "b": 2}
    assert epochs.epoch_batches(rows.limit(0), "key", 2, 4).collect() == []


def test_ways_cross_borders(spark):
    """Against all pixels of the raster: long slanting ways, ways along a border, outside, of one point, of equal points."""
    rng = random.Random(2)
    tile, rows, columns, box = 10, 3, 4, (0.0, 0.0, 29.0, 39.0)
    lines = {k: [(rng.uniform(-8, 37), rng.uniform(-8, 47)) for _ in range(rng.randrange(2, 5))] for k in range(12)}
    lines |= {20: [(19.0, 0.0), (19.0, 39.0)], 21: [(29.0, 9.5), (0.0, 9.5)], 22: [(5.0, 5.0)], 23: [(8.0, 8.0), (8.0, 8.0)], 24: [(60.0, 60.0), (70.0, 70.0)], 25: [(-5.0, -5.0), (34.0, 44.0)]}
    points = [(w, k, 29 - y, x) for w, line in lines.items() for k, (y, x) in enumerate(line)]
    got = {tuple(r) for r in ways.ways_to_tiles(spark.createDataFrame(points, "way_id long, pos int, lat double, lon double").repartition(3), box, tile, rows, columns, 3).collect()}
    want = set()
    for line in lines.values():
        for (ya, xa), (yb, xb) in zip(line, line[1:]):
            for y in range(30):
                for x in range(40):
                    size = (yb - ya) ** 2 + (xb - xa) ** 2
                    t = max(0, min(1, ((y - ya) * (yb - ya) + (x - xa) * (xb - xa)) / size)) if size else 0
                    if (y - ya - t * (yb - ya)) ** 2 + (x - xa - t * (xb - xa)) ** 2 <= 2.25 + 1e-12:
                        want.add((y // tile * columns + x // tile, y % tile, x % tile))
    assert got == want


def test_segments_go_to_the_tiles_on_their_way_only(spark):
    segments = spark.createDataFrame([(1, 0.0, 0.0, 99.0, 99.0)], "way_id long, ya double, xa double, yb double, xb double")
    tiles = {(r.ty, r.tx) for r in ways.dealt_segments(segments, 10, 10, 10, 1.5).collect()}
    assert {(k, k) for k in range(10)} <= tiles and all(abs(a - b) <= 1 for a, b in tiles)


def test_terrains_do_not_depend_on_partitions(spark):
    tiles = spark.range(40).select(F.col("id").cast("int").alias("tile_id"))
    one = sorted(map(tuple, synthetic.synthetic_tiles(tiles.repartition(2), 16, 24).collect()))
    assert one == sorted(map(tuple, synthetic.synthetic_tiles(tiles.repartition(9), 16, 24).collect())) and len(one) == 40 * 16 * 24
    assert one != sorted(map(tuple, synthetic.synthetic_tiles(tiles, 16, 24, seed=7).collect())) and all(0 <= c <= 255 for r in one for c in r[3:])
    drawn = np.array([r.z for r in spark.range(20_000).select(synthetic.normal("z", "id").alias("z")).collect()])
    assert abs(drawn.mean()) < 0.03 and abs(drawn.std() - 1) < 0.03 and abs((drawn**4).mean() - 3) < 0.3
    with pytest.raises(ValueError):
        synthetic.synthetic_tiles(tiles, 15, 24)
