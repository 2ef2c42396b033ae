"""Which windows of a corpus stand in it more than once: the common part of the
substring operators.

1. Each text is cut into runs of windows that share their least gram (the
   anchor). Equal windows have equal anchors, so only runs under one anchor
   can hold equal windows. About one row leaves a task for 15 words or 170 bytes.
2. Counts prune: runs whose anchor stands once hold no window that repeats.
3. Of each different run that is left one copy goes, with its bytes, to the
   operator's own method, which compares it with all others of its anchor and
   finds the windows that repeat; of a run that stands more than once, two
   copies from two places go, so that the method itself meets the repetition.
   What it finds for a run holds for all places of the run.
4. An anchor with more than `hot` different runs is dealt anew, a run for each
   window, under the window's own fingerprint: windows that stand once are
   pruned, two copies of the others go the same way. So no group that is
   compared grows without bound.

Runs are equal if two independent 64-bit fingerprints agree, of the anchor and of the whole run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import BYTE_VALUES, Prints, Words, chunks, lists, ranges, row_of, window_runs
from .names import ddl
from .session import cut

#: Positions that are looked at together where anchors are placed.
PLACED = 1 << 18
#: Bytes of runs that leave a task in one batch, and rows that are looked at together where they are compared.
PIECE_BYTES = 1 << 20
PIECE_ROWS = 1024
#: Runs that splitters are sampled from.
SPLITTER_SAMPLE = 4096


@dataclass(frozen=True)
class Rule:
    """A window length in units (words or bytes), the gram whose least value is the anchor.

    An anchor of more than `hot` different runs (about 10 MB of them, and what
    one task can compare in 200 MB) is dealt by windows; block_bytes of runs,
    whole anchors, are compared at once.
    """

    unit: str
    window: int
    gram: int
    hot: int = 16_384
    block_bytes: int = 1 << 20

    def units(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unit values, rows' bounds, and the byte range of each unit."""
        if self.unit == "bytes":
            at = np.arange(len(values))
            return BYTE_VALUES[values], offsets, at, at + 1
        words = Words(values, offsets)
        return words.prints(), words.bounds, words.starts, words.stops


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, a hash that tells rows of one doc_id apart, and the text; other columns go."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def different(texts: DataFrame) -> DataFrame:
    """texts with `copies`, how often a row stands in it; only where any row stands twice are they brought together."""
    key = ["doc_id", "text_key"]
    if texts.groupBy(*key).count().where("count > 1").isEmpty():
        return texts.withColumn("copies", F.lit(1))
    return texts.groupBy(*key).agg(F.first("text").alias("text"), F.count("*").cast("int").alias("copies"))


def _type(df: DataFrame, name: str) -> str:
    return ddl(df.schema[name].dataType)


def window_rows(texts: DataFrame, rule: Rule) -> DataFrame:
    """A row for each run of windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, offsets in chunks(batch["text"]):
                units, bounds, _, _ = rule.units(values, offsets)
                first, count, anchor, stretch = window_runs(units, bounds, rule.window, rule.gram)
                if not len(first):
                    continue
                of = row_of(bounds)[first]
                rows = pa.array(of + row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].take(rows) for c in ("doc_id", "text_key", "copies")), pa.array((first - bounds[of]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(stretch.view(np.int64))],
                    names=["doc_id", "text_key", "copies", "first", "count", "anchor", "stretch"],
                )

    return texts.mapInArrow(emit, f"doc_id {_type(texts, 'doc_id')}, text_key long, copies int, first int, count int, anchor long, stretch long")


def _anchor_places(rule: Rule, units: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The unit where the anchor of the window at each of first begins: its first least gram."""
    grams = Prints(units).grams(rule.gram)
    width = rule.window - rule.gram + 1
    step = max(1, PLACED // width)
    found = [first[k : k + step] + grams[first[k : k + step, None] + np.arange(width)].argmin(axis=1) for k in range(0, len(first), step)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _fetch(rule: Rule, splitters: list[bytes]) -> Callable:
    """Takes texts with their wanted runs; gives the bytes of each run, where its anchor begins in them, and the anchor's bucket."""
    edges = np.array(splitters, f"S{rule.gram}")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, offsets in chunks(batch["text"]):
                runs = batch["runs"].slice(row, len(offsets) - 1)
                flat = runs.flatten()
                units, bounds, starts, stops = rule.units(values, offsets)
                n = np.diff(np.asarray(runs.offsets))
                first = np.asarray(flat.field("first")) + np.repeat(bounds[:-1], n)
                last = first + np.asarray(flat.field("count")) + rule.window - 2
                begin, size = starts[first], stops[last] - starts[first]
                at, bucket = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
                if rule.unit == "bytes" and len(first):
                    lead = _anchor_places(rule, units, first)
                    at = (lead - begin).astype(np.int32)
                    bucket = np.searchsorted(edges, values[lead[:, None] + np.arange(rule.gram)].view(f"S{rule.gram}").ravel(), "right").astype(np.int32)
                # Rows leave in pieces, so that a batch of long runs stays small.
                total = np.cumsum(size)
                cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(PIECE_BYTES, int(total[-1]) if len(total) else 0, PIECE_BYTES)), [len(size)]]))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    piece = values[ranges(begin[a:b], size[a:b])]
                    ends = np.concatenate([[0], np.cumsum(size[a:b])]).astype(np.int32)
                    data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(piece)])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[a:b]), *(flat.field(c).slice(a, b - a) for c in ("anchor", "stretch", "single")), pa.array(at[a:b]), data], names=["bucket", "anchor", "stretch", "single", "at", "run"])

    return fetch


def _with_runs(texts: DataFrame, wanted: DataFrame, few: bool = False) -> DataFrame:
    runs = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "stretch", "first", "count", "single")).alias("runs"))
    runs = F.broadcast(runs) if few else runs
    return texts.join(runs, same_doc(texts, runs)).select("text", "runs")


def fetched(texts: DataFrame, wanted: DataFrame, rule: Rule, splitters: list[bytes] = [], few: bool = False) -> DataFrame:
    """bucket, anchor, stretch, single, at, run (bytes) of each of the wanted runs: doc_id, text_key, first, count, anchor, stretch, single.

    Anchors are dealt to buckets by splitters, for rules on bytes. few: wanted is of bounded size, so it goes to the texts.
    """
    return _with_runs(texts, wanted, few).mapInArrow(_fetch(rule, splitters), "bucket int, anchor long, stretch long, single boolean, at int, run binary")


def sampled_splitters(texts: DataFrame, wanted: DataFrame, rule: Rule, n: int, sample: int = SPLITTER_SAMPLE) -> list[bytes]:
    """n - 1 anchors, at most, in the order of their bytes, that part a sample of at most `sample` runs evenly. They decide balance only."""
    some = wanted.orderBy(F.xxhash64("anchor", "stretch"), "anchor", "stretch").limit(sample)
    leads = fetched(texts, some, rule, few=True).select(F.expr(f"substring(run, at + 1, {rule.gram})").alias("lead")).toArrow()["lead"].to_pylist()
    leads.sort()
    return sorted({leads[k * len(leads) // n] for k in range(1, n)}) if leads else []


def _matched(rule: Rule, match: Callable) -> Callable:
    """Whole anchors at a time, in blocks of bounded size; the anchor that a block's end cuts goes on with the next."""

    def compare(block: pa.Table) -> pa.RecordBatch | None:
        block = block.combine_chunks()
        _, values, offsets = next(chunks(block["run"].combine_chunks(), 1 << 40))
        units, bounds, _, _ = rule.units(values, offsets)
        windows = np.diff(bounds) - rule.window + 1
        anchor, stretch = np.asarray(block["anchor"]), np.asarray(block["stretch"])
        repeated = match(rule, values, units, bounds, anchor, np.asarray(block["at"]))
        # Two copies of a run are found alike; the first one speaks.
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])
        repeated &= np.repeat(first, windows)
        # Maximal runs of repeated windows, not across rows.
        row = np.repeat(np.arange(len(windows)), windows)
        opens, closes = repeated.copy(), repeated.copy()
        change = row[1:] != row[:-1]
        opens[1:] &= ~repeated[:-1] | change
        closes[:-1] &= ~repeated[1:] | change
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if not len(begin):
            return None
        head = np.cumsum(windows) - windows
        of = row[begin]
        rows = pa.array(of)
        return pa.RecordBatch.from_arrays(
            [block["anchor"].combine_chunks().take(rows), block["stretch"].combine_chunks().take(rows), pa.array((begin - head[of]).astype(np.int32)), pa.array((end - begin).astype(np.int32))],
            names=["anchor", "stretch", "skip", "windows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (x.slice(k, PIECE_ROWS) for x in batches for k in range(0, x.num_rows, PIECE_ROWS)):
            held.append(batch)
            size += batch["run"].nbytes
            if size < rule.block_bytes:
                continue
            block = pa.Table.from_batches(held)
            anchor = np.asarray(block["anchor"])
            edges = np.flatnonzero(anchor[1:] != anchor[:-1])
            if not len(edges):
                continue
            stop = int(edges[-1]) + 1
            held = block.slice(stop).combine_chunks().to_batches()
            size = sum(x["run"].nbytes for x in held)
            if (found := compare(block.slice(0, stop))) is not None:
                yield found
        if held and (found := compare(pa.Table.from_batches(held))) is not None:
            yield found

    return run


def _windows_of(rule: Rule) -> Callable:
    """Takes texts with their runs; gives each window on its own, with two fingerprints."""
    fetch = _fetch(rule, [])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fetch(batches):
            for row, values, offsets in chunks(batch["run"], 1 << 18):
                units, bounds, _, _ = rule.units(values, offsets)
                windows = np.diff(bounds) - rule.window + 1
                start = ranges(bounds[:-1], windows)
                prints = [Prints(units, family).of(start, start + rule.window).view(np.int64) for family in (0, 1)]
                rows = pa.array(np.repeat(np.arange(len(windows)), windows) + row)
                yield pa.RecordBatch.from_arrays(
                    [batch["anchor"].take(rows), batch["stretch"].take(rows), pa.array(ranges(np.zeros(len(windows), np.int64), windows).astype(np.int32)), *map(pa.array, prints)],
                    names=["anchor", "stretch", "skip", "left_print", "right_print"],
                )

    return emit


def _copies(groups: DataFrame) -> DataFrame:
    """One place of each different run, two of those that stand more than once."""
    places = F.when(F.col("n") > 1, F.array("low", "high")).otherwise(F.array("low"))
    return groups.withColumn("at", F.explode(places)).select("at.*", "count", "anchor", "stretch", F.lit(False).alias("single"))


def _hot_windows(texts: DataFrame, groups: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The windows of hot anchors (groups), each on its own: all of them, and the places of those worth comparing."""
    one = groups.select("low.*", "count", "anchor", "stretch", F.lit(False).alias("single"))
    windows = _with_runs(texts, one).mapInArrow(_windows_of(rule), "anchor long, stretch long, skip int, left_print long, right_print long")
    windows = cut(windows.join(groups.select("anchor", "stretch", "n"), ["anchor", "stretch"]))
    at = F.struct("anchor", "stretch", "skip")
    often = windows.groupBy("left_print", "right_print").agg(F.sum("n").alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).where("n > 1")
    # The second place is in another run, or the same run's second place.
    picks = often.select("left_print", "right_print", F.explode(F.array(F.struct("a.*", F.lit(False).alias("second")), F.struct("b.*", (F.col("a") == F.col("b")).alias("second")))).alias("p")).select("left_print", "right_print", "p.*")
    placed = picks.join(groups.select("anchor", "stretch", "low", "high"), ["anchor", "stretch"]).withColumn("at", F.when(F.col("second"), F.col("high")).otherwise(F.col("low")))
    wanted = placed.select("at.doc_id", "at.text_key", (F.col("at.first") + F.col("skip")).alias("first"), F.lit(1).alias("count"), F.col("left_print").alias("anchor"), F.col("right_print").alias("stretch"), F.lit(True).alias("single"))
    return windows, wanted


def repeated_windows(texts: DataFrame, rule: Rule, match: Callable, ranged: bool = False) -> DataFrame:
    """doc_id, text_key and spans, array<struct<first, windows>>: all windows that stand elsewhere too.

    texts is what keyed() gives. match(rule, bytes, units, bounds, anchors, at)
    gets a block of runs and tells for each window of it whether it stands in
    the block twice. ranged: buckets are ranges of anchors in the order of
    their bytes, between sampled splitters, and ordered so; else anchors are dealt by hash.
    """
    texts = different(texts)
    rows = window_rows(texts, rule)
    # Written apart, so that rows of a hot anchor can be split where they are joined.
    counts = cut(rows.groupBy("anchor").agg(F.sum("copies").alias("n_rows")).where("n_rows > 1").select("anchor"))
    alike = cut(rows.join(counts, "anchor").select("doc_id", "text_key", "first", "count", "anchor", "stretch", "copies"))
    place = F.struct("doc_id", "text_key", "first")
    groups = cut(alike.groupBy("anchor", "stretch").agg(F.sum("copies").alias("n"), F.min("count").alias("count"), F.min(place).alias("low"), F.max(place).alias("high")))
    crowded = cut(groups.groupBy("anchor").count().where(F.col("count") > rule.hot).select("anchor"))
    some_hot = not crowded.isEmpty()
    if some_hot:
        windows, single = _hot_windows(texts, groups.join(crowded, "anchor", "left_semi"), rule)
        wanted = cut(_copies(groups.join(crowded, "anchor", "left_anti")).unionByName(single))
    else:
        wanted = _copies(groups)
    if ranged:
        n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Windows of a hot anchor share its leading token; their own fingerprint deals them on.
        bucket = F.when(F.col("single"), F.pmod(F.xxhash64("anchor"), F.lit(n)).cast("int")).otherwise(F.col("bucket"))
        dealt = fetched(texts, wanted, rule, sampled_splitters(texts, wanted, rule, n)).repartitionById(n, bucket)
        dealt = dealt.sortWithinPartitions(F.expr(f"substring(run, at + 1, {rule.gram})"), "anchor", "stretch")
    else:
        dealt = fetched(texts, wanted, rule).repartition("anchor").sortWithinPartitions("anchor", "stretch")
    found = dealt.mapInArrow(_matched(rule, match), "anchor long, stretch long, skip int, windows int")
    if some_hot:
        found = cut(found)
        again = found.select(F.col("anchor").alias("left_print"), F.col("stretch").alias("right_print")).distinct()
        # Consecutive windows of a run become one stretch again.
        order = Window.partitionBy("anchor", "stretch").orderBy("skip")
        single = windows.join(again, ["left_print", "right_print"]).select("anchor", "stretch", "skip", (F.col("skip") - F.row_number().over(order)).alias("island"))
        found = found.unionByName(single.groupBy("anchor", "stretch", "island").agg(F.min("skip").alias("skip"), F.count("*").cast("int").alias("windows")).drop("island"))
    spans = alike.join(found, ["anchor", "stretch"]).select("doc_id", "text_key", F.struct((F.col("first") + F.col("skip")).alias("first"), F.col("windows")).alias("span"))
    return spans.groupBy("doc_id", "text_key").agg(F.collect_list("span").alias("spans"))


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Every text, with its spans or null."""
    return texts.join(spans, same_doc(texts, spans), "left").select(texts["doc_id"], texts["text"], spans["spans"])


def removed_units(rule: Rule, spans: pa.ListArray, bounds: np.ndarray) -> np.ndarray:
    """True for each unit of a chunk that a span of windows covers; spans is its rows' column."""
    spans = spans.fill_null([]) if spans.null_count else spans
    flat = spans.flatten()
    n = np.diff(np.asarray(spans.offsets))
    first = np.asarray(flat.field("first")) + np.repeat(bounds[:-1], n)
    steps = np.zeros(int(bounds[-1]) + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + np.asarray(flat.field("windows")) + rule.window - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def span_lists(mask: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Maximal runs of True as start and stop within each row."""
    row = row_of(bounds)
    opens, closes = mask.copy(), mask.copy()
    change = row[1:] != row[:-1]
    opens[1:] &= ~mask[:-1] | change
    closes[:-1] &= ~mask[1:] | change
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    head = bounds[row[begin]]
    values = pa.StructArray.from_arrays([pa.array((begin - head).astype(np.int32)), pa.array((end - head).astype(np.int32))], names=["start", "stop"])
    return lists(np.searchsorted(begin, bounds), values)
