"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, those of larger ids first. A batch's line hashes
are sorted into a run, a table in buckets by line; a merge join with the runs so
far, bucketed alike, tells which of them are new, and so which document is a
line's last holder. The batch then adds its own run; a level that has `fanout`
runs is compacted into one run of the next level, where the counts of a line
are summed. Runs are stored and can be taken up by a later call.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import chunks, row_of
from .names import ddl, literal
from .session import bucketed, bucketed_at, cut, shared_folder, table

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 3
FANOUT = 2
#: Ids that the bounds of the batches are sampled from.
SPLITTER_SAMPLE = 1000
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


class LineRuns:
    """Runs of (line, n_docs, last_id), by level; last_id is null where an earlier batch has the last holder.

    A run is a stored table in buckets by line, each sorted by it, so that batches and runs, and runs among
    themselves, meet bucket by bucket: no run is shuffled or sorted anew. state() names the stored runs; resumed()
    goes on from there in another session. Batches come by falling ids, whichever call they come in.
    """

    def __init__(self, fanout: int = FANOUT, buckets: int | None = None, folder: str | None = None):
        self.levels: list[list[DataFrame]] = []
        self.fanout, self.buckets, self.folder = fanout, buckets, folder
        self._paths: dict[int, str] = {}

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def state(self) -> list[tuple[int, str]]:
        """(level, path) of each stored run."""
        return [(level, self._paths[id(run)]) for level, runs in enumerate(self.levels) for run in runs]

    @classmethod
    def resumed(cls, spark: SparkSession, state: list[tuple[int, str]], id_type: str, buckets: int, fanout: int = FANOUT, folder: str | None = None) -> LineRuns:
        found = cls(fanout, buckets, folder)
        for level, path in sorted(state):
            while len(found.levels) <= level:
                found.levels.append([])
            run = bucketed_at(spark, path, f"line binary, n_docs bigint, last_id {id_type}", "line", buckets)
            found.levels[level].append(run)
            found._paths[id(run)] = path
        return found

    def _store(self, run: DataFrame, shuffled: bool = False) -> DataFrame:
        path = f"{self.folder or shared_folder(run.sparkSession)}/run-{uuid.uuid4().hex}"
        stored = bucketed(run, "line", self.buckets, shuffled, path=path)
        self._paths[id(stored)] = path
        return stored

    def marked(self, own: DataFrame) -> DataFrame:
        """A batch's own run with last_id null for the lines that any run has: a merge join with each, without an exchange on either side."""
        seen = F.lit(False)
        for k, run in enumerate(self.runs()):
            own = own.join(run.select("line", F.lit(True).alias(f"in_{k}")).hint("merge"), "line", "left")
            seen = seen | F.coalesce(f"in_{k}", F.lit(False))
        return own.select("line", "n_docs", F.when(~seen, F.col("last_id")).alias("last_id"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch of (line, id), a row for each document that holds the line; returns the lines not seen before, with n_docs and last_id."""
        if self.buckets is None:
            self.buckets = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = self._store(batch.groupBy("line").agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id")), True)
        run = self._store(self.marked(own)) if self.runs() else own
        self._put(run, 0)
        return run.where("last_id IS NOT NULL")

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self.merged(self.levels[level])
            self.levels[level] = []
            self._put(self._store(merged), level + 1)

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """Sorted runs as one, counts of a line summed up: a merge join, bucket by bucket, and what it gives is stored before the next."""
        every = runs[0]
        for k, run in enumerate(runs[1:]):
            every = self._store(every) if k else every
            other = run.select("line", F.col("n_docs").alias("more"), F.col("last_id").alias("other_id")).hint("merge")
            both = every.join(other, "line", "full")
            every = both.select("line", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.coalesce("last_id", "other_id").alias("last_id"))
        return every

    def counts(self) -> DataFrame:
        return self.merged(self.runs())


def falling_parts(ids: DataFrame, parts: int, sample: int = SPLITTER_SAMPLE) -> list[Column]:
    """Conditions on doc_id that part ids, of any type with an order, into ranges of falling ids; null ids are in the last one.

    The bounds come from at most `sample` ids, chosen by hash; they decide the batches' sizes only.
    """
    some = [r[0] for r in ids.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    some.sort(reverse=True)
    edges = sorted({some[k * len(some) // parts] for k in range(1, parts)}, reverse=True) if some else []
    if not edges:
        return [F.lit(True)]
    id_ = F.col("doc_id")
    edges = [literal(x, ids.schema["doc_id"].dataType) for x in edges]
    return [id_ > edges[0], *((id_ <= a) & (id_ > b) for a, b in zip(edges, edges[1:])), (id_ <= edges[-1]) | id_.isNull()]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places of lines to drop (`gone`) to number of lines, number of dropped ones, kept text."""
    for batch in batches:
        for row, values, offsets in chunks(batch["text"]):
            n = len(offsets) - 1
            gone = batch["gone"].slice(row, n)
            gone = gone.fill_null([]) if gone.null_count else gone
            breaks = np.flatnonzero(values == 0x0A)
            per_row = np.diff(np.searchsorted(breaks, offsets)) + 1
            bounds = np.concatenate([[0], np.cumsum(per_row)])
            # A line ends behind its break, a row's last line at the row's end.
            stops = np.sort(np.concatenate([breaks + 1, offsets[1:]]), kind="stable")
            last = np.zeros(int(bounds[-1]), bool)
            last[bounds[1:] - 1] = True
            # An empty row's end sorts before or after another row's break alike: both are the same place.
            starts = np.concatenate([[0], stops[:-1]])
            size = stops - starts
            kept = np.ones(len(stops), bool)
            n_gone = np.diff(np.asarray(gone.offsets))
            kept[np.asarray(gone.flatten()) + np.repeat(bounds[:-1], n_gone)] = False
            of = row_of(bounds)
            keep = np.repeat(kept, size)
            size[~kept] = 0
            # The break behind a row's last kept line goes, unless it is the row's last line.
            taken = np.flatnonzero(kept)
            final = np.ones(len(taken), bool)
            final[:-1] = of[taken][1:] != of[taken][:-1]
            ends = taken[final]
            ends = ends[~last[ends]]
            keep[stops[ends] - 1] = False
            size[ends] -= 1
            where = np.concatenate([[0], np.cumsum(size)])[bounds].astype(np.int32)
            text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(where), pa.py_buffer(values[keep])])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, n), pa.array(per_row), pa.array(n_gone.astype(np.int64)), text], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


def line_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_key, at, line: where keys of at least least_chars code points stand, line the key's MD5."""
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    numbered = texts.select("doc_id", "text_key", F.posexplode(F.transform(lines(F.col("text")), line_key)).alias("at", "key")).where(F.char_length("key") >= least_chars)
    return numbered.select("doc_id", "text_key", "at", F.unhex(F.md5("key")).alias("line"))


def add_lines(runs: LineRuns, placed: DataFrame) -> DataFrame:
    """One batch of line_places() to the runs, a line once for each document; returns the lines not seen before."""
    return runs.add(placed.select(F.col("doc_id").alias("id"), "line").distinct())


def drop_lines(docs: DataFrame, placed: DataFrame, runs: LineRuns, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs without the lines of placed that the runs count in at least least_docs documents, but in the last one that holds them: doc_id, n_lines, n_dropped, kept_text."""
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    often = cut(runs.counts().where((F.col("n_docs") >= least_docs) & F.col("last_id").isNotNull()).select(F.col("line").alias("often"), "last_id"))
    gone = placed.join(often, F.col("line") == F.col("often")).where(~F.col("doc_id").eqNullSafe(F.col("last_id"))).groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(F.collect_set("at").alias("gone"))
    joined = texts.join(gone, F.expr("doc_id <=> gone_id AND text_key = gone_key"), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_kept, f"doc_id {ddl(texts.schema['doc_id'].dataType)}, n_lines long, n_dropped long, kept_text string")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT, runs: LineRuns | None = None) -> DataFrame:
    """Drop lines that stand in at least least_docs documents, but in the last document that holds them.

    Returns per row: doc_id, n_lines (before), n_dropped, kept_text.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased; keys under least_chars code points stay. A null or empty text
    is one empty line. Rows of one doc_id are one document, whose rows all
    keep the line if its id is the largest. A null id is an id like others and
    comes before all of them; lines that only it holds stay. Tables may be
    empty; other columns are not read. Ids of any type with an order are taken in batches alike.

    runs: stored runs of documents of larger ids, none by default; their lines count, and they take these documents' lines.
    """
    runs = LineRuns(fanout) if runs is None else runs
    placed = cut(line_places(docs, id_col, text_col, least_chars))
    for part in falling_parts(docs.select(F.col(f"`{id_col}`").alias("doc_id")), batches):
        add_lines(runs, placed.where(part))
    return drop_lines(docs, placed, runs, id_col, text_col, least_docs)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH s AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM s)
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
  SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, i, line, o.key IS NOT NULL AND last_id <> k.doc_id AS gone FROM k LEFT JOIN o ON o.key = k.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
