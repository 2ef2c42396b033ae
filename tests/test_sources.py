import json

import numpy as np

from waymend.sources.artifact import artifact_lines, deliverable
from waymend.operators.raster import extract_patches, gray_to_rgb
from waymend.operators.relational import epoch_means, sample_rows
from waymend.sources.images import encode_png, foreground, image_pngs, mask_pngs, paired_images, patch_pngs, pixels, read_images, write_patches, write_pngs
from waymend.sources.synthetic import grid_graph, synthetic_tile


def test_png_roundtrip(spark, tmp_path):
    mask = spark.createDataFrame([(3, 1, 2), (3, 4, 0), (3, 1, 2)], "tile_id int, y int, x int")
    row = mask_pngs(mask, 6, 5).first()
    (tmp_path / "tile.png").write_bytes(row.png)
    images = read_images(spark, str(tmp_path))
    assert sorted((r.y, r.x) for r in foreground(images).collect()) == [(1, 2), (4, 0)]
    colour = np.zeros((2, 3, 3), np.uint8)
    colour[1, 2] = (10, 20, 30)
    (tmp_path / "tile.png").write_bytes(encode_png(colour))
    r = read_images(spark, str(tmp_path)).first()
    assert bytes(r.data)[-3:] == bytes((30, 20, 10)) and (r.height, r.width, r.channels) == (2, 3, 3)
    assert paired_images(images, images).count() == 1


def test_artifact_has_no_bare_infinity(spark):
    nodes = spark.createDataFrame([(1, 2.0, 3.0)], "id long, y double, x double")
    edges = spark.createDataFrame([(1, 2, float("inf"))], "u long, v long, weight double")
    rows = [json.loads(r.value) for r in artifact_lines(nodes, edges, {"scale": "10"}).collect()]
    assert [r["kind"] for r in rows] == ["metadata", "node", "edge"] and "weight" not in rows[2]


def test_deliverable_rounds(spark):
    row = spark.createDataFrame([(7, 0.98765, 1.2345, 0.12345, True, 2)], "closed_node_id long, resilience_index double, travel_time_impact_pct double, affected_segment_length_km double, disconnected boolean, disconnected_pair_count long")
    assert tuple(deliverable(row).first()) == (7, 0.9876, 1.23, 0.123, True, 2) or deliverable(row).first().resilience_index == 0.9877


def test_generators(spark):
    assert grid_graph(spark).count() == 60
    tile = synthetic_tile(spark, 16, 16)
    assert tile.count() == 256 and tile.where("r < 0 OR r > 255").isEmpty()


def test_images_and_patches_are_written(spark, tmp_path):
    mask = spark.createDataFrame([(t, k, (k * 7 + t) % 20) for t in range(2) for k in range(20)], "tile_id int, y int, x int")
    saved = write_pngs(image_pngs(gray_to_rgb(mask, 90), 20, 20), str(tmp_path / "tiles"), "tile").collect()
    assert sorted(r.saved_path for r in saved) == [str(tmp_path / "tiles" / f"tile_{t}.png") for t in range(2)]
    back = pixels(read_images(spark, str(tmp_path / "tiles"))).where("r = 90 AND g = 90 AND b = 90")
    assert back.count() == mask.count() and not list((tmp_path / "tiles").glob("*.png.*"))
    patches = patch_pngs(extract_patches(mask, 20, 20, 8, 2), 8)
    write_patches(patches, str(tmp_path / "patches"))
    written = spark.read.parquet(str(tmp_path / "patches"))
    names = {t: sorted(r.name for r in written.where(f"tile_id = {t}").collect()) for t in range(2)}
    n = {t: patches.where(f"tile_id = {t}").count() for t in range(2)}
    for t in range(2):
        train = n[t] * 8 // 10
        assert names[t] == sorted([f"patch_{k:03d}.png" for k in range(train)] + [f"val_patch_{k:03d}.png" for k in range(n[t] - train)])


def test_means_and_samples(spark):
    batches = spark.createDataFrame([(1, 2.0, 3), (1, 4.0, 1), (2, 1.0, 0)], "epoch int, loss double, n int")
    assert sorted(map(tuple, epoch_means(batches).collect())) == [(1, 2.5), (2, 0.0)]
    files = spark.createDataFrame([(f"f{k}",) for k in range(30)], "name string")
    some = [r.name for r in sample_rows(files, "name", 4).collect()]
    assert len(set(some)) == 4 and some == [r.name for r in sample_rows(files.repartition(3), "name", 4).collect()] != [r.name for r in sample_rows(files, "name", 4, seed=7).collect()]
