"""Masks small enough to work out by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymend import session
from waymend.operators import chains, labels, losses, raster

PIXELS = "tile_id int, y int, x int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def box(spark, y0, y1, x0, x1):
    return spark.createDataFrame([(0, y, x) for y in range(y0, y1) for x in range(x0, x1)], PIXELS)


def test_mask_metrics(spark):
    gt, pred, occ = box(spark, 30, 70, 30, 70), box(spark, 32, 68, 32, 68), box(spark, 40, 50, 40, 50)
    r = raster.mask_iou_dice(pred, gt).first()
    assert (r.iou, round(r.dice, 5)) == (0.81, 0.89503)
    assert raster.mask_relaxed_iou(pred, gt, 4, 100, 100).first().relaxed_iou == 0.81
    assert raster.occlusion_recall(pred, gt, occ).first().recall == 1.0


def test_recall_without_occlusion(spark):
    assert raster.occlusion_recall(box(spark, 0, 1, 0, 1), box(spark, 0, 2, 0, 2), box(spark, 9, 10, 9, 10)).first().recall == 1.0


def test_tiling_covers_and_stitches(spark):
    assert raster.starts(512, 256, 32) == [0, 224, 256]
    mask = box(spark, 0, 20, 0, 20)
    patches = raster.extract_patches(mask, 20, 20, 8, 2)
    assert patches.select("patch_id").distinct().count() == 9
    back = raster.stitch_patches(patches, 20, 20, 8, 2)
    assert back.where("value = 255").count() == 400
    with pytest.raises(ValueError):
        raster.starts(4, 8, 2)


def test_ellipse_rows():
    assert [sum(1 for dy, _ in raster.ellipse(4) if dy == r) for r in range(-4, 5)] == [1, 7, 7, 9, 9, 9, 7, 7, 1]


def test_full_mask_has_no_morphological_skeleton(spark):
    assert raster.morph_skeleton(box(spark, 0, 8, 0, 8), 8, 8).count() == 0


def test_bar_thins_to_a_line(spark):
    left = raster.skeletonize(box(spark, 5, 9, 0, 20))
    assert 0 < left.count() < 40


def test_skeleton_graph_of_a_cross(spark):
    cross = [(0, 5, x) for x in range(0, 11)] + [(0, y, 5) for y in range(0, 11) if y != 5]
    edges = chains.skeleton_graph(spark.createDataFrame(cross, PIXELS)).collect()
    degree = {}
    for e in edges:
        degree[e.u] = degree.get(e.u, 0) + 1
        degree[e.v] = degree.get(e.v, 0) + 1
    assert sum(1 for d in degree.values() if d == 1) == 4 and all(e.weight == pytest.approx(10 * e.length_px) for e in edges)


def test_ring_has_no_edge(spark):
    ring = [(0, y, x) for y, x in [(0, 1), (0, 2), (1, 3), (2, 3), (3, 2), (3, 1), (2, 0), (1, 0)]]
    assert chains.skeleton_graph(spark.createDataFrame(ring, PIXELS)).count() == 0


def test_area_filter_and_classes(spark):
    mask = spark.createDataFrame([(0, 0, x) for x in range(15)] + [(0, 5, 0), (0, 6, 1)], PIXELS)
    assert labels.component_area_filter(mask, 15).count() == 15
    kinds = {r.kind: r.n for r in raster.pixel_classify(mask).groupBy("kind").count().toDF("kind", "n").collect()}
    assert kinds == {"endpoint": 4, "interior": 13}


def test_binarize_scales(spark):
    scores = spark.createDataFrame([(0, 0, 0, 0.6), (0, 0, 1, 0.5), (1, 0, 0, 200.0), (1, 0, 1, 100.0)], f"{PIXELS}, p double")
    assert rows(raster.binarize(scores)) == [(0, 0, 0), (1, 0, 0)]


def test_losses_of_a_perfect_mask(spark):
    dense = raster.grid(spark.createDataFrame([(0,)], "tile_id int"), 6, 6).selectExpr("*", "CASE WHEN y = 3 THEN 0.999999 ELSE 0.000001 END AS p", "CASE WHEN y = 3 THEN 1.0D ELSE 0.0D END AS t")
    r = losses.composite_loss(dense.withColumn("p", dense.p.cast("double"))).first()
    assert r.dice_loss < 1e-4 and r.bce_loss < 1e-4 and r.boundary_loss < 1e-3 and r.total_loss > 0


def test_road_bends_and_ways(spark):
    """The bent diagonal of the road mask passes its three bends; a way of one point draws nothing."""
    mask = {(r.y, r.x) for r in raster.synthetic_road_mask(spark.createDataFrame([(0,)], "tile_id int"), 100, 100).collect()}
    assert {(10, 10), (35, 40), (85, 70), (60, 55)} <= mask and (90, 90) not in mask
    ways = [(0, 1, 0, 2.0, 2.0), (0, 1, 1, 2.0, 9.0), (0, 2, 0, 5.0, 5.0), (0, 3, 0, -4.0, 0.0), (0, 3, 1, -1.0, 3.0)]
    drawn = raster.rasterize_ways(spark.createDataFrame(ways, "tile_id int, way_id int, pos int, y double, x double"), 12, 12, 3)
    near = lambda y, x, a, b: math.dist((y, x), (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))) if (t := max(0, min(1, ((y - a[0]) * (b[0] - a[0]) + (x - a[1]) * (b[1] - a[1])) / math.dist(a, b) ** 2))) is not None else 0
    want = sorted((0, y, x) for y in range(12) for x in range(12) if near(y, x, (2, 2), (2, 9)) <= 1.5 or near(y, x, (-4, 0), (-1, 3)) <= 1.5)
    assert rows(drawn) == want


def test_skeleton_nodes_hold_lone_pixels(spark):
    found = raster.skeleton_nodes(spark.createDataFrame([(0, 1, 1), (0, 5, 5), (0, 5, 6), (0, 5, 7)], PIXELS)).select("y", "x", "degree", "is_endpoint")
    assert rows(found) == [(1, 1, 0, True), (5, 5, 1, True), (5, 7, 1, True)]


def test_blur_resize_and_channels(spark):
    rng = np.random.default_rng(3)
    image = rng.random((9, 7))
    cells = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(9) for x in range(7)], PIXELS + ", p double")
    line = np.exp(-((np.arange(5) - 2) ** 2) / 2)
    kernel = np.outer(line, line) / line.sum() ** 2
    padded = np.pad(image, 2, mode="reflect")
    want = {(y, x): (padded[y : y + 5, x : x + 5] * kernel).sum() for y in range(9) for x in range(7)}
    got = {(r.y, r.x): r.p for r in raster.gaussian_blur(cells, ["p"], 9, 7).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    same = {(r.y, r.x): r.p for r in raster.resize(cells, ["p"], 9, 7, 9, 7).collect()}
    assert same == {(y, x): pytest.approx(image[y, x]) for y in range(9) for x in range(7)}
    flat = raster.resize(cells.withColumn("p", F.lit(0.5)), ["p"], 9, 7, 4, 13).collect()
    assert len(flat) == 52 and all(r.p == pytest.approx(0.5) for r in flat)
    rgb = spark.createDataFrame([(0, 1, 2, 10, 20, 255)], PIXELS + ", r int, g int, b int")
    assert rows(raster.swap_channels(rgb)) == [(0, 1, 2, 255, 20, 10)]
    assert rows(raster.normalise(rgb))[0][5] == 1.0
    assert rows(raster.side_by_side([rgb, raster.gray_to_rgb(rgb)], 8)) == [(0, 1, 2, 10, 20, 255), (0, 1, 10, 255, 255, 255)]


def test_augment_turns_image_and_mask_alike(spark):
    rng = np.random.default_rng(5)
    pixels = [(t, y, x, int(rng.integers(256)), 7, 250) for t in range(12) for y in range(4) for x in range(4)]
    image = spark.createDataFrame(pixels, PIXELS + ", r int, g int, b int")
    done = {t: np.zeros((4, 4), int) for t in range(12)}
    still = raster.augment(image, 4, 4, brightness=0.0)
    for r in still.collect():
        done[r.tile_id][r.y, r.x] = r.r
    ways = set()
    for t in range(12):
        before = np.array([p[3] for p in pixels if p[0] == t]).reshape(4, 4)
        turned = {(f, k): np.rot90(before[:, ::-1] if f else before, k) for f in (0, 1) for k in range(4)}
        match = [way for way, a in turned.items() if (a == done[t]).all()]
        assert match
        ways.add(match[0])
    assert len(ways) > 2
    places = lambda df: rows(df.select(*PIXELS.replace(" int", "").split(", ")))
    assert places(raster.augment(image.select("tile_id", "y", "x"), 4, 4)) == places(raster.augment(image, 4, 4))
    bright = raster.augment(image, 4, 4, brightness=1.0).collect()
    assert all(0 <= c <= 255 for r in bright for c in (r.r, r.g, r.b)) and len({r.g for r in bright}) > 3


def walked(points):
    """Chains of a skeleton by walking: (u, v) to the best (length, first pixel, points)."""
    near = {p: [(p[0] + dy, p[1] + dx) for dy, dx in raster.NEIGHBOURS if (p[0] + dy, p[1] + dx) in points] for p in points}
    nodes = {p for p in points if len(near[p]) != 2}
    best = {}
    for u in nodes:
        for first in near[u]:
            path = [u, first]
            while path[-1] not in nodes:
                path.append(next(q for q in near[path[-1]] if q != path[-2]))
            if u < path[-1]:
                found = (sum(math.dist(a, b) for a, b in zip(path, path[1:])), first, path)
                key = (u, path[-1])
                if key not in best or (round(found[0], 9), first) < (round(best[key][0], 9), best[key][1]):
                    best[key] = found
    return best


def test_paths_go_from_end_to_end(spark):
    rng = np.random.default_rng(7)
    points = {(int(y), int(x)) for y, x in np.argwhere(rng.random((40, 40)) < 0.3)}
    # Two ways of one length around a block, and a spiral.
    points |= {(60, x) for x in range(0, 21)} | {(64, x) for x in range(5, 16)} | {(y, x) for y in (61, 62, 63) for x in (4, 16)} | {(80, 3), (81, 4), (81, 5), (80, 6)}
    got = {(tuple(e.pixel_path[0]), tuple(e.pixel_path[-1])): e for e in chains.skeleton_graph(spark.createDataFrame([(0, *p) for p in points], PIXELS).repartition(5)).collect()}
    want = walked(points)
    assert set(got) == set(want)
    for key, (length, _, path) in want.items():
        assert [tuple(p) for p in got[key].pixel_path] == path and got[key].length_px == pytest.approx(length) and got[key].weight == pytest.approx(10 * length)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A snake of some 20,000 pixels."""
    points, y = [], 0
    for k in range(100):
        points += [(y, x) for x in (range(1, 200) if k % 2 == 0 else range(199, 0, -1))] + [(y + 1, 200 if k % 2 == 0 else 0)]
        y += 2
    written = []
    monkeypatch.setattr(chains, "cut", lambda df, cut=chains.cut: written.append(1) or cut(df))
    (edge,) = chains.skeleton_graph(spark.createDataFrame([(3, *p) for p in points], PIXELS).repartition(4)).collect()
    path = [tuple(p) for p in edge.pixel_path]
    assert path in (points, points[::-1]) and len(path) == 20_000
    assert edge.length_px == pytest.approx(sum(math.dist(a, b) for a, b in zip(path, path[1:]))) and len(written) <= 4 + 15


@pytest.mark.parametrize("cell", [1, 3, 8, 256])
def test_labels_by_cells(spark, cell):
    rng = np.random.default_rng(9)
    pixels = [(t, int(y), int(x)) for t in (0, 4) for y, x in np.argwhere(rng.random((24, 31)) < 0.35)]
    pixels += [(7, y, x) for y in range(3, 20) for x in range(-6, 9)] + [(7, 50, 50)] * 3
    points, label = set(pixels), {}
    for p in sorted(points):
        if p not in label:
            todo, label[p] = [p], p
            while todo:
                t, y, x = todo.pop()
                for q in ((t, y + dy, x + dx) for dy, dx in raster.NEIGHBOURS):
                    if q in points and q not in label:
                        label[q] = p
                        todo.append(q)
    side = 1 << 20
    got = rows(labels.pixel_components(spark.createDataFrame(pixels, PIXELS).repartition(3), cell).select(*raster.PIXEL, "label"))
    assert got == sorted((*p, (q[0] * side + q[1]) * side + q[2]) for p, q in label.items())


def test_inner_pixels_stay_out_of_the_rounds(spark, monkeypatch):
    """Only labels that meet at borders of cells are linked."""
    seen = []
    monkeypatch.setattr(labels, "connected_components", lambda links, real=labels.connected_components: seen.append(links.count()) or real(links))
    assert labels.pixel_components(box(spark, 0, 64, 0, 64), 32).select("label").distinct().count() == 1
    assert seen == [6]
    assert labels.pixel_components(box(spark, 0, 30, 0, 30), 32).count() == 900 and len(seen) == 1


def test_wide_blur_and_its_limits(spark):
    rng = np.random.default_rng(13)
    image = rng.random((40, 33))
    cells = spark.createDataFrame([(t, y, x, float(image[y, x]) + t) for t in (0, 1) for y in range(40) for x in range(33)], PIXELS + ", p double").repartition(3)
    line = np.array(raster.gaussian_line(51))
    assert line.sum() == pytest.approx(1) and line[25] / line[26] == pytest.approx(math.exp(1 / 128))
    padded = np.pad(image, 25, mode="reflect")
    want = np.array([[(padded[y : y + 51, x : x + 51] * np.outer(line, line)).sum() for x in range(33)] for y in range(40)])
    got = raster.gaussian_blur(cells, ["p"], 40, 33, 51, 0.0).collect()
    assert len(got) == 2640 and all(r.p == pytest.approx(want[r.y, r.x] + r.tile_id) for r in got)
    with pytest.raises(ValueError):
        raster.gaussian_blur(cells, ["p"], 40, 33, 67)


def test_blur_in_one_task_or_by_lines(spark, monkeypatch):
    """Both ways give the same sums; an image in a task takes one exchange, where each pass took one."""
    cells = raster.grid(spark.createDataFrame([(0,), (4,)], "tile_id int"), 30, 41).withColumns({"p": F.sin(F.col("y") * 41 + F.col("x") + F.col("tile_id")), "q": F.when((F.col("y") != 3) | (F.col("x") != 8), F.col("x").cast("double"))})
    one = raster.gaussian_blur(cells, ["p", "q"], 30, 41, 51, 0.0)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    found = sorted(map(str, one.collect()))
    monkeypatch.setattr(raster, "IMAGE_PIXELS", 100)
    assert found == sorted(map(str, raster.gaussian_blur(cells, ["p", "q"], 30, 41, 51, 0.0).collect()))
    # A missing value leaves none within its reach.
    assert {r.q is None for r in one.where("y < 28 AND x < 33").collect()} == {True} and one.where("x > 33 AND q IS NULL").isEmpty()


def thinned_one_by_one(pixels):
    """Two-pass thinning of a set of (tile, y, x) until nothing changes."""
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = pixels
        for second in (False, True):
            gone = set()
            for t, y, x in pixels:
                p = [(t, y + dy, x + dx) in pixels for dy, dx in ring]
                turns = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
                corners = (p[0] and p[2] and p[6]) or (p[0] and p[4] and p[6]) if second else (p[0] and p[2] and p[4]) or (p[2] and p[4] and p[6])
                if 2 <= sum(p) <= 6 and turns == 1 and not corners:
                    gone.add((t, y, x))
            pixels = pixels - gone
        if pixels == before:
            return pixels


def test_thinning_by_cells(spark, monkeypatch):
    """Cells thinned with what lies around them give what thinning the whole mask gives, in rounds that follow the width and not the number of iterations."""
    rng = random.Random(9)
    rows = [(t, y, x) for t in (0, 1, 40) for y in range(-70, 30) for x in range(90) if rng.random() < (0.1, 0.93, 0.6)[t % 3]] + [(3, 5, 5), (3, 5, 5), (None, 1, 1), (5, None, 2), (5, None, 2), (8, 0, 0), (8, 0, 1), (8, 1, 0), (8, 1, 1)]
    mask = spark.createDataFrame(rows, "tile_id int, y int, x int").repartition(3)
    odd = {r for r in rows if None in r}
    want = sorted(map(str, thinned_one_by_one(set(rows) - odd) | odd))
    for cell in (256, 33):
        assert sorted(map(str, map(tuple, raster.skeletonize(mask, cell=cell).collect()))) == want
    # A bar of 90 rows takes some 45 iterations, which were as many rounds of joins; a tile of one cell takes one.
    tables = []
    monkeypatch.setattr(raster, "cut", lambda df: tables.append(1) or session.cut(df))
    assert raster.skeletonize(box(spark, 0, 90, 0, 120)).count() > 0 and len(tables) == 1


def test_relaxed_iou_by_cells(spark):
    """Cells with the target around them count what a dilated target gives; its rows are counts of cells, not a row for each pixel and offset."""
    rng = random.Random(2)
    some = lambda: [(t, rng.randrange(-6, 70), rng.randrange(-6, 75)) for t in (0, 1, 1, 30) for _ in range(150)]
    pred, target = (spark.createDataFrame(sorted(set(some())) + [(7, 1, k)] + [(1, None, 3), (None, 2, 2)] * (k == 1), "tile_id int, y int, x int") for k in (1, 60))
    for tolerance in (0, 4, 11):
        wide = raster.dilate(target, raster.ellipse(tolerance), 64, 66)
        hits = {r.tile_id: r.n for r in pred.join(wide, raster.PIXEL, "left_semi").groupBy("tile_id").agg(F.count("*").alias("n")).collect()}
        union = {r.tile_id: r.n for r in pred.union(target).distinct().groupBy("tile_id").agg(F.count("*").alias("n")).collect()}
        want = {t: min(1.0, hits.get(t, 0) / n) for t, n in union.items()}
        for cell in (256, 13):
            got = raster.mask_relaxed_iou(pred, target, tolerance, 64, 66, cell=cell)
            assert {r.tile_id: r.relaxed_iou for r in got.collect()} == want
        assert "Generate explode(array" not in got._jdf.queryExecution().executedPlan().toString()
