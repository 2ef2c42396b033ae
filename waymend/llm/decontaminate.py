"""Benchmark decontamination: an FM-index per training shard.

The test phrases are the query set, taken in blocks of bounded size, broadcast
to the tasks. For each block the training texts stream by, one shard at a time: words that stand in
no phrase end a segment, segments shorter than the shortest phrase go, and the
rest is indexed (wavelet matrix over the Burrows-Wheeler transform). All
phrases are searched backwards together, their occurrences located by sampled
suffix positions, and the spans of each document merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .kernels import IS_ALNUM, LOWER, Words, chunks, covered, lists, ranges, row_of, spans_of
from .names import Inner
from .session import cut, table

WINDOW = 13
#: Bytes of benchmark text that one pass over the documents takes.
BLOCK_BYTES = 8 << 20
#: Words of one shard's index, at most, but for a single longer document.
SHARD_WORDS = 1 << 18
#: Runs of what is a word character after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Phrases:
    """The distinct windows of a block of benchmark items, over the block's own vocabulary."""

    def __init__(self, items: pa.Table, window: int):
        prints, of = [], []
        for row, values, offsets in chunks(items["text"], 1 << 40):
            words = Words(LOWER[values], offsets, IS_ALNUM)
            prints.append(words.prints())
            n = np.diff(words.bounds)
        prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.vocabulary, symbols = np.unique(prints, return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(n)]) if len(prints) else np.zeros(len(items) + 1, np.int64)
        n = np.diff(bounds)
        count = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        start, item = ranges(bounds[:-1], count), np.repeat(np.arange(len(n)), count)
        length = np.minimum(n[item], window)
        at = start[:, None] + np.arange(window)
        rows = np.where(np.arange(window) < length[:, None], symbols[np.minimum(at, max(0, len(symbols) - 1))] + 1, 0) if len(symbols) else np.zeros((0, window), np.int64)
        self.patterns, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.ravel()
        self.lengths = (self.patterns > 0).sum(axis=1)
        pairs = np.unique(np.stack([which, item], axis=1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
        self.items_at = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))
        self.items = pairs[:, 1]
        self.names = [None if x is None else str(x) for x in items["item_id"].to_pylist()]
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        # One bit for each leading 20 bits of a fingerprint: rules out most words at once.
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def symbols(self, prints: np.ndarray) -> np.ndarray:
        """Symbols from 1 up, 0 for a word of no phrase."""
        found = np.zeros(len(prints), np.int64)
        maybe = np.flatnonzero(self.sieve[(prints >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, prints[maybe]), len(self.vocabulary) - 1)
        found[maybe] = np.where(self.vocabulary[at] == prints[maybe], at + 1, 0)
        return found


def _scan(sent: Broadcast, text: str = "text") -> Callable:
    def shard(phrases: Phrases, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start and stop of each occurrence among the words of the shard; its word, its item."""
        none = np.zeros(0, np.int64)
        inside = symbols > 0
        row = row_of(bounds)
        opens, closes = inside.copy(), inside.copy()
        change = row[1:] != row[:-1]
        opens[1:] &= ~inside[:-1] | change
        closes[:-1] &= ~inside[1:] | change
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long_ = end - begin >= max(1, phrases.shortest)
        begin, size = begin[long_], (end - begin)[long_]
        if not len(begin):
            return none, none, none, none
        starts = np.cumsum(size + 1) - size - 1
        text = np.zeros(int((size + 1).sum()), np.int64)
        places = ranges(starts, size)
        origin = ranges(begin, size)
        text[places] = symbols[origin]
        index = FMIndex(text, depth=int(size.max()) + 1, every=16, sigma=len(phrases.vocabulary) + 1)
        lo, hi = index.search(phrases.patterns, phrases.lengths)
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        at = index.locate(ranges(lo, count))
        back = np.zeros(len(text), np.int64)
        back[places] = origin
        start = back[at]
        n_items = phrases.items_at[which + 1] - phrases.items_at[which]
        return start, start + phrases.lengths[which], np.repeat(start, n_items), phrases.items[ranges(phrases.items_at[which], n_items)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for batch in batches:
            for row, values, offsets in chunks(batch[text], 6 * SHARD_WORDS):
                n = len(offsets) - 1
                words = Words(LOWER[values], offsets, IS_ALNUM)
                total = int(words.bounds[-1])
                start = stop = at = item = np.zeros(0, np.int64)
                if len(phrases.patterns):
                    start, stop, at, item = shard(phrases, phrases.symbols(words.prints()), words.bounds)
                of = row_of(words.bounds)
                hit = covered(total, start, stop)
                # Merge per row: cut the runs at row bounds.
                edges = hit.copy()
                ends = hit.copy()
                change = of[1:] != of[:-1]
                edges[1:] &= ~hit[:-1] | change
                ends[:-1] &= ~hit[1:] | change
                begin, end = np.flatnonzero(edges), np.flatnonzero(ends) + 1
                base = words.bounds[of[begin]]
                merged = lists(np.searchsorted(begin, words.bounds), pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], names=["start", "stop"]))
                pairs = np.unique(np.stack([of[at], item], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
                found: list[list] = [[] for _ in range(n)]
                for r, i in pairs:
                    found[r].append(phrases.names[i])
                yield pa.RecordBatch.from_arrays(
                    [*(x.slice(row, n) for x in batch.columns), pa.array(np.diff(words.bounds)), merged, pa.array(found, pa.list_(pa.string()))],
                    names=[*batch.schema.names, "n_words", "hits", "items"],
                )

    return scan


def _merged(hits: F.Column) -> F.Column:
    """Spans in any order, as maximal ones."""
    kind = "array<struct<start:int,stop:int>>"

    def add(done: F.Column, x: F.Column) -> F.Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        meets = (F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["stop"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(hits), F.array().cast(kind), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Find every occurrence of every benchmark window in the documents.

    Adds to all columns of docs: n_words (long), hits (merged spans, array of
    start and stop in words), items (ids of the items with an occurring window,
    as strings). Columns of docs with these names give way to the new ones.

    Words are runs of a-z, 0-9 and characters outside ASCII after A-Z are
    lower-cased. A window is `window` words of an item; an item of fewer, but
    not none, is one window. Null and empty texts have no words and no hits. A
    null item_id counts as an item without a name: its windows hit, its id is
    null in items. Equal items of different ids both count. Repeated rows are
    judged alike, an empty table on either side gives no hits.

    The benchmark is the stated query set. Different items go in blocks of
    about block_bytes of text (one item at least), one on the driver at a time. One block is
    searched in one pass over the documents, without a shuffle. Several
    take a pass each, which keeps only the texts it hits; these are
    brought together by the texts' fingerprints (MD5) and joined to the documents.
    """
    spark = docs.sparkSession
    queries = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null").distinct()
    total = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    kinds = "n_words long, hits array<struct<start:int,stop:int>>, items array<string>"

    def sent(k: int) -> Broadcast:
        return spark.sparkContext.broadcast(Phrases(queries.where(part == k).toArrow(), window))

    inner = Inner(docs, ("n_words", "hits", "items"))
    text = inner.at(text_col)
    if n_blocks == 1:
        found = inner.df.mapInArrow(_scan(sent(0), text), inner.schema(kinds))
    else:
        texts = inner.df.select(F.md5(text).alias("print"), F.col(text).alias("text"))
        hit = None
        for k in range(n_blocks):
            phrases = sent(k)
            one = texts.mapInArrow(_scan(phrases), f"print string, text string, {kinds}").where("size(hits) > 0").select("print", F.struct(F.lit(k).alias("block"), "hits", "items").alias("found"))
            # What a block hits is written before the next block is sent.
            one = cut(one)
            phrases.destroy()
            hit = one if hit is None else hit.unionByName(one)
        hit = cut(hit.groupBy("print").agg(F.collect_set("found").alias("found")))
        hit = hit.select("print", _merged(F.flatten("found.hits")).alias("hits"), F.flatten("found.items").alias("items"))
        found = inner.df.withColumn("print", F.md5(text)).join(hit, "print", "left").withColumn("n_words", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
        found = found.withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<start:int,stop:int>>"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return found.select(*inner.outer(), "n_words", "hits", F.array_distinct("items").alias("items"))


def n_hit() -> F.Column:
    return F.expr("aggregate(hits, 0L, (n, x) -> n + x.stop - x.start)")


def contaminated() -> F.Column:
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM q), t AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (SELECT doc_id, i, n, item_id FROM t JOIN q USING (n, phrase)),
hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
