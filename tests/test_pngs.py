"""PNG files written and read as a data source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymend.sources import pngs
from waymend.sources.images import encode_png, pixels, read_images


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.startswith("."))


def test_training_files_and_back(spark, tmp_path):
    rng = np.random.default_rng(4)
    image = {(t, y, x): tuple(int(c) for c in rng.integers(0, 256, 3)) for t in (0, 5) for y in range(20) for x in range(20)}
    mask = {(0, y, x) for y in range(20) for x in range(20) if rng.random() < 0.1}
    rows = spark.createDataFrame([(*p, *c) for p, c in image.items()], "tile_id int, y int, x int, r int, g int, b int").repartition(4)
    made = pngs.training_files(rows, spark.createDataFrame(sorted(mask), "tile_id int, y int, x int"), 20, 20, 8, 2)
    pngs.write_png_files(made.repartition(3), str(tmp_path / "out"))
    names = [f"{split}/{kind}/{t}_{label}{k:03d}.png" for t in (0, 5) for split, label, n in (("train", "patch_", 7), ("val", "val_patch_", 2)) for k in range(n) for kind in ("images", "masks")]
    assert files(tmp_path / "out") == sorted(names)
    back = pngs.read_pngs(spark, str(tmp_path / "out"))
    assert sorted(f"{r.folder}/{r.name}" for r in back.collect()) == sorted(names)
    assert {(r.folder.split("/")[1], r.height, r.width, r.channels) for r in back.collect()} == {("images", 8, 8, 3), ("masks", 8, 8, 1)}
    # The fourth patch of tile 0 begins at row 6, column 0; another reader sees the same pixels.
    seen = {(r.y, r.x): (r.r, r.g, r.b) for r in pixels(read_images(spark, str(tmp_path / "out/train/images")).where("name = '0_patch_003.png'")).collect()}
    assert seen == {(y, x): image[0, 6 + y, x] for y in range(8) for x in range(8)}
    seen = {(r.y, r.x) for r in pixels(read_images(spark, str(tmp_path / "out/train/masks")).where("name = '0_patch_003.png'")).where("r = 255").collect()}
    assert seen == {(y - 6, x) for t, y, x in mask if 6 <= y < 14 and x < 8}
    pairs = pngs.paired_patches(spark, str(tmp_path / "out"), "val").collect()
    assert len(pairs) == 4 and all(r.image != r.mask for r in pairs)
    (tmp_path / "out/val/masks/5_val_patch_001.png").unlink()
    with pytest.raises(Exception, match="no mask for 5_val_patch_001.png"):
        pngs.paired_patches(spark, str(tmp_path / "out"), "val").collect()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    good = encode_png(np.zeros((2, 2), np.uint8))
    rows = spark.createDataFrame([("a", f"{k}.png", bytearray(good)) for k in range(40)] + [("a", "bad.png", bytearray(b"no image"))], "folder string, name string, png binary").repartition(5)
    with pytest.raises(Exception, match="not a PNG file"):
        pngs.write_png_files(rows, str(tmp_path / "out"))
    assert files(tmp_path) == []
    whole = rows.where("name <> 'bad.png'")
    pngs.write_png_files(whole, str(tmp_path / "out"))
    assert len(files(tmp_path / "out")) == 40 and not (tmp_path / "out/_staging").exists()
    # Files that are there stay unless told otherwise; a name that stands twice is an error, and what was there stays.
    with pytest.raises(Exception, match="40 files are there already"):
        pngs.write_png_files(whole, str(tmp_path / "out"))
    pngs.write_png_files(whole, str(tmp_path / "out"), overwrite=True)
    with pytest.raises(Exception, match="1 names stand twice"):
        pngs.write_png_files(whole.where("name = '1.png'").union(whole.where("name = '1.png'")).withColumn("folder", F.lit("b")), str(tmp_path / "out"))
    assert len(files(tmp_path / "out")) == 40
    assert pngs.read_pngs(spark, str(tmp_path / "out")).where("channels = 1 AND height = 2").count() == 40


def test_an_empty_folder(spark, tmp_path):
    pngs.write_png_files(spark.createDataFrame([], "folder string, name string, png binary"), str(tmp_path / "none"))
    (tmp_path / "none").mkdir(exist_ok=True)
    assert pngs.read_pngs(spark, str(tmp_path / "none")).count() == 0
