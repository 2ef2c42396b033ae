"""Substring dedup: a compressed FM-index per shard.

Runs of words that may repeat are dealt to shards by anchor (see overlap.py), so
that a shard holds every place that a run of it can match. Each shard joins its
runs into one text, builds an FM-index over it (a bit-packed wavelet matrix of
the Burrows-Wheeler transform), and streams the runs through it backwards: the
matching statistics of each word are the length of the longest stretch from
there that stands in the shard at least twice. Words covered by an interval of
at least `window` words go. Counts only prune what is indexed; every removal
comes from an index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .kernels import Words, chunks, ranges, row_of
from .overlap import Rule, keyed, removed_units, repeated_windows, span_lists, with_spans
from .names import ddl
from .session import table

RULE = Rule("words", window=35, gram=8)


def shard_matches(rule: Rule, values: np.ndarray, units: np.ndarray, bounds: np.ndarray, anchors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each window of each run of a shard, whether it stands in the shard at least twice."""
    symbols = np.unique(units, return_inverse=True)[1] + 1
    n = np.diff(bounds)
    starts = bounds[:-1] + np.arange(len(n))
    text = np.zeros(len(units) + len(n), np.int64)
    text[ranges(starts, n)] = symbols
    index = FMIndex(text, depth=int(n.max()) + 1, common=True)
    longest = index.matching_statistics(starts, starts + n)
    return longest[ranges(starts, n - rule.window + 1)] >= rule.window


def _kept(rule: Rule):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, offsets in chunks(batch["text"]):
                words = Words(values, offsets)
                gone = removed_units(rule, batch["spans"].slice(row, len(offsets) - 1), words.bounds)
                kept = np.flatnonzero(~gone)
                size = words.stops[kept] - words.starts[kept] + 1
                out = np.append(values, np.uint8(0x20))[ranges(words.starts[kept], size)]
                ends = np.cumsum(size)
                out[ends - 1] = 0x20
                of = row_of(words.bounds)[kept]
                last = np.ones(len(kept), bool)
                last[:-1] = of[1:] != of[:-1]
                keep = np.ones(len(out), bool)
                keep[ends[last] - 1] = False
                per_row = np.bincount(of, weights=size, minlength=len(offsets) - 1).astype(np.int64)
                per_row -= per_row > 0
                where = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
                text = pa.Array.from_buffers(pa.string(), len(per_row), [None, pa.py_buffer(where), pa.py_buffer(out[keep])])
                removed = np.concatenate([[0], np.cumsum(gone)])[words.bounds]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(row, len(per_row)), pa.array(np.diff(words.bounds)), pa.array(np.diff(removed)), span_lists(gone, words.bounds), text],
                    names=["doc_id", "n_words", "n_removed", "removed", "kept_text"],
                )

    return finish


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE) -> DataFrame:
    """Remove each word covered by a window of `rule.window` words that stands anywhere else too.

    Returns per row: doc_id, n_words, n_removed, removed (array of start and
    stop, in words), kept_text (the kept words joined by one space).

    Windows are judged on the input, all its copies removed alike. A null or
    empty text has no words and an empty kept_text. Repeated rows are copies
    of each other, rows that share a doc_id with different texts stay apart, a
    null doc_id is an id like others. An empty table gives an empty table.
    Other columns are not read. A task holds its longest text.
    """
    texts = keyed(docs, id_col, text_col)
    spans = repeated_windows(texts, rule, shard_matches)
    kind = ddl(texts.schema["doc_id"].dataType)
    return with_spans(texts, spans).mapInArrow(_kept(rule), f"doc_id {kind}, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35
), h AS (
  SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h FROM p
), hit AS (
  SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM hit
), g AS (
  SELECT doc_id, count(*) AS n, list(i) AS places FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN words ELSE
    [words[k] FOR k IN range(1, len(words) + 1) IF NOT list_contains(places, k)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""
