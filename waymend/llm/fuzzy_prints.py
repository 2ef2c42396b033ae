"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last 7 bytes sets the boundaries: at block size 2**k it
is one where the hash's k lowest bits are 0, so the boundaries of a size are
among those of all smaller ones, and an edit moves only those near it. Each
piece between boundaries gives one letter. A text's block size is the largest
that cuts it into LEAST_PIECES pieces; its fingerprint is that size and the
signatures at it and at the two next larger sizes. Two fingerprints compare by
edit distance at the smallest size that both have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import BYTE_VALUES, CHUNK_BYTES, Prints, mixed
from .session import cut, table

ROLL = 7
#: Block sizes are 2**LEAST_LEVEL to 2**MOST_LEVEL.
LEAST_LEVEL, MOST_LEVEL = 2, 31
LEAST_PIECES = 32
#: A signature's last letter stands for all that follows the letters before it.
MOST_LETTERS = 64
SIZES = 3
#: The letters of signatures.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _chunk_fingerprints(texts: list[bytes]) -> list[str]:
    pad = b"\0" * ROLL
    values = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + ROLL) - sizes
    stops = starts + sizes
    rolled = Prints(BYTE_VALUES[values]).grams(ROLL)
    # The hash of the ROLL bytes up to and with a byte; its lowest zero bits are the byte's level.
    low = rolled & (~rolled + np.uint64(1))
    level = np.where(low == 0, 64, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64)
    places = np.flatnonzero(level >= LEAST_LEVEL) + ROLL - 1
    of = np.searchsorted(starts, places, "right") - 1
    within = (of >= 0) & (places >= starts[of]) & (places < stops[of])
    places, of = places[within], of[within]
    level = np.minimum(level[places - ROLL + 1], MOST_LEVEL)
    n = len(texts)
    counts = np.zeros((n, MOST_LEVEL + 2), np.int64)
    np.add.at(counts, (of, level), 1)
    counts = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    # Pieces at a level: its boundaries, and one more unless the last byte is one of them.
    enough = counts[:, LEAST_LEVEL : MOST_LEVEL + 1] >= LEAST_PIECES
    chosen = LEAST_LEVEL + np.maximum(enough.sum(axis=1) - 1, 0)
    content = Prints(mixed(BYTE_VALUES[values] ^ np.uint64(0x5DEECE66D)), family=1)
    bounds = np.searchsorted(of, np.arange(n + 1))
    done = []
    for k in range(n):
        here, levels = places[bounds[k] : bounds[k + 1]], level[bounds[k] : bounds[k + 1]]
        parts = []
        for step in range(SIZES):
            ends = here[levels >= chosen[k] + step] + 1
            cuts = np.concatenate([starts[k : k + 1], ends, stops[k : k + 1][: 0 if len(ends) and ends[-1] == stops[k] else 1]])
            if len(cuts) > MOST_LETTERS + 1:
                cuts = np.append(cuts[:MOST_LETTERS], stops[k])
            marks = content.of(cuts[:-1], cuts[1:]) >> np.uint64(58) if sizes[k] else ()
            parts.append("".join(LETTERS[m] for m in marks))
        done.append(f"{1 << chosen[k]}:" + ":".join(parts))
    return done


def fingerprints_of(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text, worked out over chunks of about CHUNK_BYTES."""
    done, chunk, size = [], [], 0
    for text in texts:
        if chunk and size + len(text) > CHUNK_BYTES:
            done += _chunk_fingerprints(chunk)
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    return done + _chunk_fingerprints(chunk) if chunk else done


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Insertions, deletions and replacements between pairs of signatures: the columns of all pairs' tables as bits of 64-bit numbers, a letter of b at a time."""
    n = len(a)
    size_a, size_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    has = np.zeros((n, 128), np.uint64)
    for k in range(int(size_a.max(initial=0))):
        rows = np.flatnonzero(size_a > k)
        has[rows, [ord(a[r][k]) for r in rows]] |= np.uint64(1 << k)
    one = np.uint64(1)
    last = np.maximum(size_a - 1, 0).astype(np.uint64)
    plus, minus, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), size_a.copy()
    for k in range(int(size_b.max(initial=0))):
        rows = np.flatnonzero((size_b > k) & (size_a > 0))
        p, m = plus[rows], minus[rows]
        same = has[rows, [ord(b[r][k]) for r in rows]]
        across = (((same & p) + p) ^ p) | same
        up, down = m | ~(across | p), p & across
        score[rows] += ((up >> last[rows]) & one).astype(np.int64) - ((down >> last[rows]) & one).astype(np.int64)
        up, down = (up << one) | one, down << one
        level = same | m
        plus[rows], minus[rows] = down | ~(level | up), up & level
    return np.where(size_a > 0, score, size_b)


def likeness_of(a: list[str], b: list[str]) -> np.ndarray:
    """From 0 to 1: one minus the edit distance over the longer signature, at the smallest block size that both fingerprints have; 0 without one, 1 for equal fingerprints."""
    left, right, rows = [], [], []
    found = np.array([float(x == y) for x, y in zip(a, b)])
    for k, (x, y) in enumerate(zip(a, b)):
        if x == y:
            continue
        size_x, *parts_x = x.split(":")
        size_y, *parts_y = y.split(":")
        step = int(size_x).bit_length() - int(size_y).bit_length()
        if abs(step) >= SIZES:
            continue
        s, t = parts_x[max(-step, 0)], parts_y[max(step, 0)]
        if s or t:
            left.append(s), right.append(t), rows.append(k)
    if rows:
        longest = np.array([max(len(s), len(t)) for s, t in zip(left, right)])
        found[rows] = 1 - edit_distances(left, right) / longest
    return found


def fingerprint(text: F.Column) -> F.Column:
    """A text column's fingerprints; null counts as empty."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints_of([(t or "").encode() for t in texts]))

    return of(F.coalesce(text, F.lit("")))


def likeness(a: F.Column, b: F.Column) -> F.Column:
    """Likeness of two columns of fingerprints; null where one is null."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        both = (x.notna() & y.notna()).to_numpy()
        found = np.full(len(x), np.nan)
        found[both] = likeness_of(list(x[both]), list(y[both]))
        return pd.Series(found).astype(object).where(both, None)

    return of(a, b)


FOUND = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _edited(texts: list[str], following: list[str], marks: list[str], next_marks: list[str]) -> list[pa.Array]:
    """The FOUND columns of texts, each edited with the one that follows it."""
    halves = [len(t) // 2 for t in texts]
    edited = [(t[: len(t) - h] + f[:h]).encode() for t, f, h in zip(texts, following, halves)]
    edited_marks = fingerprints_of(edited)
    columns = [[len(t) for t in texts], [hashlib.sha256(e).hexdigest() for e in edited], marks, edited_marks, likeness_of(marks, edited_marks), likeness_of(marks, next_marks)]
    return [pa.array(c, kind) for c, kind in zip(columns, FOUND.values())]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to rows with their FOUND columns, but the last one; it and the first one come with their texts, as `tail` and `head`."""
    held, part = None, 0

    def bare(row: pa.Array, text: str, role: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([row, *(pa.nulls(1, k) for k in FOUND.values()), pa.array([role]), pa.array([part], pa.int32()), pa.array([text])], names=names)

    names = ["doc_id", *FOUND, "role", "part", "text"]
    for batch in batches:
        if not len(batch):
            continue
        ids, texts = batch["doc_id"], batch["text"].to_pylist()
        part = batch["part"][0].as_py()
        marks = fingerprints_of([t.encode() for t in texts])
        if held is None:
            yield bare(ids.slice(0, 1), texts[0], "head")
        else:
            ids, texts, marks = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *marks]
        n = len(texts) - 1
        if n:
            yield pa.RecordBatch.from_arrays([ids.slice(0, n), *_edited(texts[:n], texts[1:], marks[:n], marks[1:]), pa.nulls(n, pa.string()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())], names=names)
        held = (ids.slice(n, 1), texts[n], marks[n])
    if held is not None:
        yield bare(held[0], held[1], "tail")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, following = batch["text"].to_pylist(), batch["following"].to_pylist()
        marks, next_marks = (fingerprints_of([t.encode() for t in x]) for x in (texts, following))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *_edited(texts, following, marks, next_marks)], names=["doc_id", *FOUND])


def fuzzy_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of what they become when their second half gives way to the next text's beginning.

    Returns per row: doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The next text is that of the next smaller
    id, after the last one the first; null ids come last, rows of one id go by
    the MD5 of their texts, equal rows in any order. A null text is empty, an
    empty one has empty signatures. One row is its own next one. An empty table gives an empty table. Other columns are not read.

    Rows are range-partitioned in their order, texts once; a partition's last
    row meets the next partition's first one in a table of two rows for each partition.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.md5(text).alias("print"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("print"), F.col("row")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])
    done = cut(placed.mapInArrow(_neighbours, T.StructType([*schema.fields, *T.StructType.fromDDL("role string, part int, text string").fields])))
    heads, tails = done.where("role = 'head'"), done.where("role = 'tail'").select("doc_id", "part", "text")
    along = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("part").over(along), F.min("part").over(Window.partitionBy())).alias("after"))
    joined = tails.join(after, "part").join(heads.select(F.col("part").alias("after"), F.col("text").alias("following")), "after").select("doc_id", "text", "following")
    return done.where("role IS NULL").select(*schema.names).unionByName(joined.mapInArrow(_pairs, schema))


def op13_fuzzy_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_prints(table(spark, sf_dir, "documents"))
