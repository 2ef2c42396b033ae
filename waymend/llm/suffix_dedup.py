"""Suffix-array dedup over bytes.

The suffixes that are ordered begin at anchors (see overlap.py), and each
stands for the windows around its anchor. Splitters sampled from the anchors'
bytes, the leading token, range-partition them, so buckets are ranges of
suffixes in the order of their bytes. A bucket orders what it has by its
leading token, then the windows of equal ones by multikey quicksort: windows
that hold the anchor at the same place are ordered by their next eight bytes,
only where these are equal by the eight after them, and so on. Windows
that are equal to their last byte repeat. Where a block of a bucket ends inside
a leading token, that token goes on with the next block, so suffixes are
compared across the boundary; splitters never part equal leading tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import chunks, ranges
from .overlap import Rule, keyed, removed_units, repeated_windows, span_lists, with_spans
from .names import ddl
from .session import table

RULE = Rule("bytes", window=400, gram=64)
TOKEN_BYTES = 8


def equal_windows(values: np.ndarray, starts: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """For each start, whether another one of its group has the same `window` bytes: multikey quicksort, all groups at once."""
    padded = np.append(values, np.zeros(TOKEN_BYTES, np.uint8)).tobytes()
    tokens = np.ndarray((len(values) + 1,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(group, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = group[order][1:] != group[order][:-1]
    last = max(0, window - TOKEN_BYTES)
    for depth in [*range(0, last, TOKEN_BYTES), last]:
        alone = fresh & np.append(fresh[1:], True)
        order, fresh = order[~alone], fresh[~alone]
        if not len(order):
            break
        token = tokens[starts[order] + depth]
        if window < TOKEN_BYTES:
            token >>= np.uint64(8 * (TOKEN_BYTES - window))
        parts = (token[1:] != token[:-1]) & ~fresh[1:]
        if not parts.any():
            continue
        # Groups whose members differ in this token are ordered by it and parted.
        of = np.cumsum(fresh) - 1
        mixed = np.zeros(of[-1] + 1, bool)
        mixed[of[1:][parts]] = True
        at = np.flatnonzero(mixed[of])
        by = at[np.lexsort((token[at], of[at]))]
        order[at], token[at] = order[by], token[by]
        fresh[1:] |= token[1:] != token[:-1]
    alone = fresh & np.append(fresh[1:], True)
    found = np.zeros(len(starts), bool)
    found[order[~alone]] = True
    return found


def bucket_matches(rule: Rule, values: np.ndarray, units: np.ndarray, bounds: np.ndarray, anchors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each window of the runs of a block, whether it stands in the block twice."""
    windows = np.diff(bounds) - rule.window + 1
    starts = ranges(bounds[:-1], windows)
    fresh = np.concatenate([[True], anchors[1:] != anchors[:-1]])
    # Windows can be equal only under one leading token that they hold at the same place.
    offset = np.repeat(at + bounds[:-1], windows) - starts
    group = np.repeat(np.cumsum(fresh), windows) * (rule.window + 1) + offset
    return equal_windows(values, starts, group, rule.window)


def _kept(rule: Rule):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, offsets in chunks(batch["text"]):
                n = len(offsets) - 1
                gone = removed_units(rule, batch["spans"].slice(row, n), offsets)
                removed = np.concatenate([[0], np.cumsum(gone)])[offsets]
                where = (offsets - removed).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(where), pa.py_buffer(values[~gone])])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(row, n), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), span_lists(gone, offsets), kept],
                    names=["doc_id", "n_bytes", "n_removed", "removed", "kept"],
                )

    return finish


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """Remove each byte covered by a string of `rule.window` bytes that starts anywhere else too.

    Returns per row: doc_id, n_bytes, n_removed, removed (array of start and
    stop, in bytes), kept (binary; a cut may fall inside a character).

    Texts are UTF-8 bytes, null counts as empty; matches never cross
    documents, overlaps count, strings are judged on the input. Repeated rows
    are copies of each other, rows that share a doc_id with different texts
    stay apart, a null doc_id is an id like others. An empty table gives an
    empty table. Other columns are not read. A task holds its longest text.
    """
    texts = keyed(docs, id_col, text_col)
    spans = repeated_windows(texts, rule, bucket_matches, ranged=True)
    kind = ddl(texts.schema["doc_id"].dataType)
    return with_spans(texts, spans).mapInArrow(_kept(rule), f"doc_id {kind}, n_bytes long, n_removed long, removed array<struct<start:int,stop:int>>, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), p AS (
  SELECT doc_id, unnest(range(0, n - 399)) AS i, x FROM b WHERE n >= 400
), h AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM p
), hit AS (
  SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)
), run AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER d + 400 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM run) GROUP BY doc_id, g
), gap AS (
  SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(z - a) AS gone, max(z) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gap JOIN b USING (doc_id) GROUP BY doc_id
)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN kept.doc_id IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM b LEFT JOIN kept ON b.doc_id = kept.doc_id
"""
