"""Vector code compression: a codebook for each part of the vectors, by Lloyd's rounds that follow changes only.

Vectors become integers once, in a table bucketed by row. Each round reads it
beside the last round's assignments, bucketed alike, so neither is shuffled;
a task adds up what leaves and what joins each entry among the parts whose
assignment changes, and only these sums are brought together. The running
integer sums and the codebooks, a few thousand numbers, stay on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .along import SHARES
from .names import ddl
from .session import bucketed, cut, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components are whole numbers of 1 / SCALE; beyond this they are out of range.
MOST = 1 << 28
#: Rows of a bucket, about.
BUCKET_ROWS = 200_000
CHUNK_ROWS = 4096
STATE = "kind int, rid long, codes binary, error long, part int, entry int, n long, sums array<long>"


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = PARTS) -> DataFrame:
    """rid, vec_id, label, data (32-bit integers) of the rows that can be cut into parts."""
    vector, scaled = F.col(f"`{vector_col}`"), F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") * SCALE)
    fine = vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.forall(scaled, lambda x: F.coalesce((x >= -MOST) & (x < MOST), F.lit(False)))
    named = rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.when(fine, F.transform(scaled, lambda x: F.floor(x).cast("int"))).alias("whole"))
    return named.where("whole IS NOT NULL").withColumn("rid", F.monotonically_increasing_id())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of integers, all of one length, as bytes."""
    for batch in batches:
        whole = batch["whole"]
        values = np.asarray(whole.flatten(), np.int32)
        offsets = (np.asarray(whole.offsets, np.int64) - whole.offsets[0].as_py()) * 4
        data = pa.Array.from_buffers(pa.binary(), len(whole), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())])
        yield pa.RecordBatch.from_arrays([batch["rid"], batch["vec_id"], batch["label"], data], names=["rid", "vec_id", "label", "data"])


def nearest(data: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of data (rows, parts, width), the first of equal ones, and its squared distance."""
    found, least = np.zeros(data.shape[:2], np.uint8), None
    for e in range(books.shape[1]):
        far = data - books[:, e]
        far = np.einsum("npw,npw->np", far, far)
        if least is None:
            least = far
        else:
            nearer = far < least
            found[nearer] = e
            least = np.where(nearer, far, least)
    return found, least


def _assign(books: np.ndarray, deltas: bool):
    """Rows (rid, data, codes) to their new codes, and to the sums of what changed: n and sums are what each entry gains, or loses where negative."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "rid", "codes", "error", "part", "entry", "n", "sums"]
        gain, n_gain, some = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), None
        for batch in batches:
            for at in range(0, len(batch), CHUNK_ROWS):
                piece = batch.slice(at, CHUNK_ROWS)
                rows = len(piece)
                data = np.frombuffer(b"".join(piece["data"].to_pylist()), np.int32).reshape(rows, parts, width).astype(np.int64)
                codes, far = nearest(data, books)
                old = piece["codes"]
                known = np.asarray(old.is_valid())
                before = np.zeros((rows, parts), np.uint8)
                before[known] = np.frombuffer(b"".join(old.drop_null().to_pylist()), np.uint8).reshape(-1, parts)
                some = piece["rid"][0].as_py() if some is None else some
                if deltas:
                    for p in range(parts):
                        changed = ~known | (codes[:, p] != before[:, p])
                        left = changed & known
                        for sign, which, where in ((1, changed, codes), (-1, left, before)):
                            np.add.at(gain[p], where[which, p], sign * data[which, p])
                            n_gain[p] += sign * np.bincount(where[which, p], minlength=entries)
                none = lambda kind: pa.nulls(rows, kind)
                packed = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, rows * parts + 1, parts, dtype=np.int32)), pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), piece["rid"], packed, pa.array(far.sum(axis=1)), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))], names=names)
        moved = np.argwhere((n_gain != 0) | (gain != 0).any(axis=2))
        if len(moved):
            p, e = moved.T
            one = len(moved)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ones(one, np.int32)), pa.array([some] * one, pa.int64()), pa.nulls(one, pa.binary()), pa.nulls(one, pa.int64()), pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)),
                pa.array(n_gain[p, e]), pa.array(gain[p, e].tolist(), pa.list_(pa.int64())),
            ], names=names)

    return run


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of vectors, and the codebooks (parts, entries, width) of whole numbers of 1 / SCALE.

    The table has vec_id, label, codes (a byte for each part), error (squared
    distances summed over the parts) for each usable vector. A vector is left out if
    it is null, empty, has null or non-finite components, components beyond MOST / SCALE (65,536), or
    another length than the first usable one, whose length the parts have to divide.
    A codebook begins with the parts of the first `entries` vectors by id, a null
    id last, vectors of one id by their numbers; there are fewer entries if there are fewer vectors. An entry
    without parts stays as it is. Equal rows are rows of their own, labels may be
    null. Without a usable vector table and codebooks are empty.
    """
    spark = rows.sparkSession
    whole = usable(rows, id_col, vector_col, label_col, parts)
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(1).select(F.size("whole")).first()
    width = (first[0] if first else 0) // parts
    whole = whole.where(F.size("whole") == width * parts)
    # `entries` rows: what the codebooks begin with.
    seeds = [r[0] for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()]
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    schema = f"rid long, vec_id {ddl(rows.schema[id_col].dataType)}, label {ddl(rows.schema[label_col].dataType)}, data binary"
    if not seeds:
        return spark.createDataFrame([], schema).select("vec_id", "label", F.col("data").alias("codes"), F.col("rid").alias("error")), books
    packed = cut(whole.select("rid", "vec_id", "label", "whole").mapInArrow(_packed, schema))
    buckets = max(spark.sparkContext.defaultParallelism, -(-packed.count() // BUCKET_ROWS))
    vectors = bucketed(packed, "rid", buckets)
    state = None
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for k in range(rounds + 1):
        beside = vectors.select("rid", "data")
        beside = beside.withColumn("codes", F.lit(None).cast("binary")) if state is None else beside.join(state.where("kind = 0").select("rid", "codes"), "rid")
        done = beside.select("rid", "data", "codes").mapInArrow(_assign(books, k < rounds), STATE)
        state = bucketed(done, "rid", buckets, shuffled=False, by="kind")
        if k < rounds:
            # A row for each part and entry at most.
            changes = state.where("kind = 1").groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width))).collect()
            for r in changes:
                counts[r.part, r.entry] += r.n
                sums[r.part, r.entry] += np.array(r[3:], np.int64)
            used = counts > 0
            books = books.copy()
            books[used] = sums[used] // counts[used][:, None]
            if not changes:
                # Nothing moved, so nothing will: the codes are final.
                break
    codes = state.where("kind = 0").select("rid", "codes", "error")
    return vectors.join(codes, "rid").select("vec_id", "label", "codes", "error"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: error summed over the rows of one label, nulls together.

    Labels that hold more than a part in SHARES of the rows are sent to them; there are less than SHARES of these.
    """
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n_label")))
    total = sums.agg(F.coalesce(F.sum("n_label"), F.lit(0))).first()[0]
    often = F.col("n_label") * SHARES > total
    hot = F.broadcast(sums.where(often).withColumnRenamed("label", "as_label"))
    cold = sums.where(~often).withColumnRenamed("label", "as_label")
    same = F.col("label").eqNullSafe(F.col("as_label"))
    return coded.join(hot, same).unionByName(coded.join(hot, same, "left_anti").join(cold, same)).drop("as_label", "n_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    steps = []
    for k in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT rid, part, any_value(vec_id) AS vec_id, any_value(label) AS label, any_value(x) AS x, arg_min(e, d * {entries} + e) AS e, min(d) AS d "
            f"FROM (SELECT p.*, b.e, CAST({far} AS BIGINT) AS d FROM p JOIN b{k} b ON b.part = p.part) GROUP BY rid, part)"
        )
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT part, e, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (SELECT part, e, pos, sum(v) AS s, count(*) AS n FROM (SELECT part, e, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{k}) GROUP BY part, e, pos)), "
                f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT part, e, list(v ORDER BY pos) AS x FROM m{k} GROUP BY part, e) m ON m.part = b.part AND m.e = b.e)"
            )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS rid, vec_id, label, x FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
), p AS MATERIALIZED (
  SELECT rid, vec_id, label, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS x FROM v, range({parts}) r(part)
), b0 AS (SELECT part, rid - 1 AS e, x FROM p WHERE rid <= {entries}),
{', '.join(steps)},
o AS (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM b{rounds}) AS codebooks_sha256 FROM o
"""


SQL = _sql()
