"""PNG images in and out of pixel relations."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import positional_split
from ..session import cut


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """name, height, width, channels, data (rows of BGR or gray bytes, top first) of the images below path."""
    rows = spark.read.format("image").load(path).select("image.*")
    return rows.select(F.element_at(F.split("origin", "/"), -1).alias("name"), "height", "width", F.col("nChannels").alias("channels"), "data")


def paired_images(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images with the mask of the same name; an image without one is an error when the rows are read."""
    named = masks.select("name", F.col("data").alias("mask"), F.col("channels").alias("mask_channels"))
    joined = images.join(named, "name", "left")
    found = F.assert_true(F.col("mask").isNotNull(), F.concat(F.lit("no mask for "), F.col("name")))
    return joined.withColumn("mask", F.when(found.isNull(), F.col("mask")))


def pixels(images: DataFrame) -> DataFrame:
    """name, y, x, r, g, b for each pixel; gray images have equal channels."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                data = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
                y, x = np.divmod(np.arange(row.height * row.width), row.width)
                b, g, r = (data[:, :, k if row.channels >= 3 else 0].ravel().astype(np.int32) for k in range(3))
                yield pd.DataFrame({"name": row.name, "y": y.astype(np.int32), "x": x.astype(np.int32), "r": r, "g": g, "b": b})

    return images.mapInPandas(explode, "name string, y int, x int, r int, g int, b int")


def foreground(images: DataFrame, least: int = 127) -> DataFrame:
    """name, y, x of the pixels of a mask above `least`."""
    return pixels(images).where(F.col("r") > least).select("name", "y", "x")


def encode_png(image: np.ndarray) -> bytes:
    """A PNG file of an 8-bit gray or RGB image."""
    height, width = image.shape[:2]
    colour = 2 if image.ndim == 3 else 0
    lines = b"".join(b"\0" + image[y].astype(np.uint8).tobytes() for y in range(height))

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def mask_pngs(mask: DataFrame, height: int, width: int) -> DataFrame:
    """tile_id, png: a gray image of each tile (tile_id, y, x), of one fixed size."""

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width), np.uint8)
        image[pdf["y"], pdf["x"]] = 255
        return pd.DataFrame({"tile_id": [key[0]], "png": [encode_png(image)]})

    return mask.select("tile_id", "y", "x").distinct().groupBy("tile_id").applyInPandas(draw, "tile_id int, png binary")


def image_pngs(image: DataFrame, height: int, width: int) -> DataFrame:
    """tile_id, png: an RGB image of each tile (tile_id, y, x, r, g, b), of one fixed size; pixels that are missing are black."""

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        drawn = np.zeros((height, width, 3), np.uint8)
        drawn[pdf["y"], pdf["x"]] = pdf[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"tile_id": [key[0]], "png": [encode_png(drawn)]})

    return image.select("tile_id", "y", "x", "r", "g", "b").groupBy("tile_id").applyInPandas(draw, "tile_id int, png binary")


def write_pngs(pngs: DataFrame, path: str, name: str = "tile") -> DataFrame:
    """Each of pngs (tile_id, png) as a file `<name>_<tile_id>.png` below path; returns tile_id and saved_path once all are written.

    Tasks write their own tiles to a file system that they share, each file under another name first, so a
    task that runs twice leaves whole files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
        files.create_dir(folder)
        for batch in batches:
            paths = [f"{folder}/{name}_{t}.png" for t in batch["tile_id"].to_pylist()]
            for to, png in zip(paths, batch["png"].to_pylist()):
                part = f"{to}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write(png)
                files.move(part, to)
            yield pa.RecordBatch.from_arrays([batch["tile_id"], pa.array(paths, pa.string())], names=["tile_id", "saved_path"])

    return cut(pngs.select("tile_id", "png").mapInArrow(write, "tile_id int, saved_path string"))


def patch_pngs(patches: DataFrame, patch: int) -> DataFrame:
    """tile_id, patch_id, y_start, x_start, png: a gray image of each patch (pixels in patch coordinates)."""

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        drawn = np.zeros((patch, patch), np.uint8)
        drawn[pdf["y"], pdf["x"]] = 255
        return pd.DataFrame({"tile_id": [key[0]], "patch_id": [key[1]], "y_start": [pdf["y_start"].iloc[0]], "x_start": [pdf["x_start"].iloc[0]], "png": [encode_png(drawn)]})

    return patches.groupBy("tile_id", "patch_id").applyInPandas(draw, "tile_id int, patch_id string, y_start int, x_start int, png binary")


def write_patches(pngs: DataFrame, path: str, share: float = 0.8) -> None:
    """Patches (of patch_pngs) below path, partitioned by split: the first `share` of each tile's patches are train, the others val.

    name is `patch_<number>.png` for train and `val_patch_<number>.png` for val, numbers of three digits from 0 in order of place.
    """
    placed = positional_split(pngs, "tile_id", ["y_start", "x_start"], share)
    number = F.row_number().over(Window.partitionBy("tile_id", "split").orderBy("y_start", "x_start")) - 1
    name = F.concat(F.when(F.col("split") == "val", "val_patch_").otherwise("patch_"), F.lpad(number.cast("string"), 3, "0"), F.lit(".png"))
    placed.withColumn("name", name).write.partitionBy("split").parquet(path)
