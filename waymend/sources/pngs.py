"""PNG files as a data source: folders of images and masks, read by partitions, written with commit and abort."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.raster import extract_patches, starts
from ..operators.relational import positional_split
from ..session import cut
from .images import encode_png

#: Files that one task reads.
TASK_FILES = 500
STAGING = "_staging"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def png_size(data: bytes) -> tuple[int, int, int]:
    """height, width and channels from a PNG file's head."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    width, height, _, colour = struct.unpack(">IIBB", data[16:26])
    return height, width, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, str]]


class PngReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        files, folder = file_system(self.path)
        found = [f for f in files.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True)) if f.is_file and f.path.endswith(".png") and f"/{STAGING}/" not in f.path]
        named = sorted((f.path[len(folder) :].strip("/"), f.path) for f in found)
        return [Files(named[i : i + TASK_FILES]) for i in range(0, len(named), TASK_FILES)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, _ = file_system(self.path)
        for name, path in partition.paths:
            with files.open_input_stream(path) as stream:
                data = stream.read()
            folder, _, last = name.rpartition("/")
            yield (folder, last, *png_size(data), data)


@dataclass
class Staged(WriterCommitMessage):
    moves: list[tuple[str, str]]
    folder: str


class PngWriter(DataSourceWriter):
    """Tasks write into folders of their own below the staging one; what all have written is moved to its place at the end."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, folder = file_system(self.path)
        own = f"{folder}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        moves = []
        try:
            files.create_dir(own)
            for k, row in enumerate(iterator):
                png_size(row["png"])
                staged = f"{own}/{k}.png"
                with files.open_output_stream(staged) as out:
                    out.write(bytes(row["png"]))
                moves.append((staged, f"{row['folder']}/{row['name']}"))
        except BaseException:
            files.delete_dir(own)
            raise
        return Staged(moves, own)

    def _clear(self) -> None:
        files, folder = file_system(self.path)
        files.delete_dir(f"{folder}/{STAGING}/{self.job}")
        staging = f"{folder}/{STAGING}"
        if not files.get_file_info(pyarrow.fs.FileSelector(staging)):
            files.delete_dir(staging)

    def commit(self, messages: list) -> None:
        files, folder = file_system(self.path)
        moves = [move for m in messages if m is not None for move in m.moves]
        places = [place for _, place in moves]
        twice = len(places) - len(set(places))
        there = [f.path for f in files.get_file_info([f"{folder}/{p}" for p in places]) if f.type != pyarrow.fs.FileType.NotFound] if places else []
        if twice or there and not self.overwrite:
            self._clear()
            raise ValueError(f"{twice} names stand twice, {len(there)} files are there already")
        for parent in {p.rpartition("/")[0] for p in places}:
            files.create_dir(f"{folder}/{parent}")
        for staged, place in moves:
            files.move(staged, f"{folder}/{place}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()


class PngSource(DataSource):
    """format("pngs"): folder, name, height, width, channels, png; written are folder, name and png. Paths without a scheme are of this machine."""

    @classmethod
    def name(cls) -> str:
        return "pngs"

    def schema(self) -> str:
        return "folder string, name string, height int, width int, channels int, png binary"

    def reader(self, schema) -> DataSourceReader:
        return PngReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PngWriter(self.options["path"], overwrite)


def read_pngs(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PngSource)
    return spark.read.format("pngs").load(path)


def write_png_files(pngs: DataFrame, path: str, overwrite: bool = False) -> None:
    """pngs (folder, name, png) as files <path>/<folder>/<name>: all of them or none. A name that stands twice, or a file that is there already, is an error."""
    pngs.sparkSession.dataSource.register(PngSource)
    pngs.select("folder", "name", "png").write.format("pngs").mode("overwrite" if overwrite else "append").save(path)


def patch_names(tiles: DataFrame, height: int, width: int, patch: int, overlap: int, share: float = 0.8) -> DataFrame:
    """tile_id, patch_id, split, name of all patches of tiles (tile_id): the first `share` of a tile's patches, by place, are train, the others val, numbered in each."""
    ys, xs = (F.explode(F.array(*map(F.lit, starts(n, patch, overlap)))) for n in (height, width))
    places = tiles.select("tile_id").distinct().withColumn("y_start", ys).withColumn("x_start", xs)
    split = positional_split(places, "tile_id", ["y_start", "x_start"], share)
    number = F.row_number().over(Window.partitionBy("tile_id", "split").orderBy("y_start", "x_start")) - 1
    name = F.concat(F.col("tile_id").cast("string"), F.when(F.col("split") == "val", "_val_patch_").otherwise("_patch_"), F.lpad(number.cast("string"), 3, "0"), F.lit(".png"))
    return split.select("tile_id", F.format_string("patch_y%d_x%d", "y_start", "x_start").alias("patch_id"), "split", name.alias("name"))


def training_files(image: DataFrame, mask: DataFrame, height: int, width: int, patch: int, overlap: int, share: float = 0.8) -> DataFrame:
    """folder, name, png for write_png_files(): the patches of images (tile_id, y, x, r, g, b) and of their masks (tile_id, y, x), by split.

    Folders are train/images, train/masks, val/images and val/masks; an image's file and its mask's have one name. All patches of
    the images' tiles are written; missing pixels are black. A patch is one task's group, patch * patch pixels at most.
    """
    names = cut(patch_names(image, height, width, patch, overlap, share))

    def draw(kind: str):
        def run(key: tuple, named: pd.DataFrame, pixels: pd.DataFrame) -> pd.DataFrame:
            if not len(named):
                return pd.DataFrame({"folder": [], "name": [], "png": []})
            drawn = np.zeros((patch, patch, 3) if kind == "images" else (patch, patch), np.uint8)
            drawn[pixels["y"].to_numpy(), pixels["x"].to_numpy()] = pixels[["r", "g", "b"]].to_numpy() if kind == "images" else 255
            return pd.DataFrame({"folder": [f"{named['split'].iloc[0]}/{kind}"], "name": [named["name"].iloc[0]], "png": [encode_png(drawn)]})

        return run

    found = None
    for kind, rows, more in (("images", image, ("r", "g", "b")), ("masks", mask, ())):
        pixels = extract_patches(rows, height, width, patch, overlap, *more).select(F.col("tile_id").alias("of"), F.col("patch_id").alias("part"), "y", "x", *more)
        files = names.groupBy("tile_id", "patch_id").cogroup(pixels.groupBy("of", "part")).applyInPandas(draw(kind), "folder string, name string, png binary")
        found = files if found is None else found.unionByName(files)
    return found


def paired_patches(spark: SparkSession, path: str, split: str) -> DataFrame:
    """name, image, mask (png) of a split's files below path; an image without a mask is an error when the rows are read."""
    every = read_pngs(spark, path)
    images, masks = (every.where(F.col("folder") == f"{split}/{kind}").select("name", F.col("png").alias(kind)) for kind in ("images", "masks"))
    joined = images.join(masks, "name", "left")
    there = F.assert_true(F.col("masks").isNotNull(), F.concat(F.lit("no mask for "), F.col("name")))
    return joined.select("name", F.col("images").alias("image"), F.when(there.isNull(), F.col("masks")).alias("mask"))
