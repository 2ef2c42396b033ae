"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard has virtual nodes on a ring; a key belongs to the arc of the next
node clockwise. A shard takes keys up to its capacity; keys that overflow go
on clockwise to the next nodes until a shard has room. Only counts of arcs, in
a fixed number of parts each, reach the driver: which ranks of an arc's keys go
to which shard follows from them, and each row then finds its place by its
rank within its part of the arc.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .along import SHARES
from .names import Inner
from .session import cut, table

SHARDS = 16
VIRTUAL_NODES = 64
#: Parts that the rows of each arc are numbered in.
SALTS = 64
RING_BITS = 32
#: Equal rows that are numbered in parts of their own: so many at least.
MANY = 10_000


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node, clockwise."""
    return sorted((zlib.crc32(f"shard {s} node {v}".encode()), s) for s in range(shards) for v in range(nodes))


def capacities(rows: int, shards: int) -> list[int]:
    """Room of each shard: together just enough, and at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def slices(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, stop rank, shard, first slot): where the keys of each arc go.

    In round k the keys still without a place ask the k-th node clockwise of
    their arc, arcs in ring order, lower ranks first.
    """
    room, used = list(room), [0] * len(room)
    placed, waiting = [], [(arc, 0, n) for arc, n in enumerate(counts) if n]
    step = 0
    while waiting:
        rest = []
        for arc, first, stop in waiting:
            shard = owners[(arc + step) % len(owners)]
            take = min(stop - first, room[shard])
            if take:
                placed.append((arc, first, first + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if first + take < stop:
                rest.append((arc, first + take, stop))
        waiting, step = rest, step + 1
    return placed


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def shard_rows(rows: DataFrame, key_col: str, shards: int = SHARDS, nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 within the shard) to rows; counts of shards are at most one apart.

    Keys are placed by hash of key_col. Within an arc rows go by their own
    hash first, so that an arc's rows, those of one hot key among them, are
    numbered in SALTS parts; then by position and all their columns (maps by
    their JSON). Repeated rows are interchangeable; where they are many (MANY, and a part in SHARES of all), they have parts of
    their own, dealt by their place in the written table. A null key is a key like
    others, a text of any length is one column's value. An empty table gives an empty table. Columns named shard or slot,
    in whatever case, are replaced, even if one is the key; all other names are free.
    """
    spark = rows.sparkSession
    inner = Inner(rows, ("shard", "slot"))
    written = cut(inner.df).withColumn("place", F.monotonically_increasing_id())
    comparable = [F.col(f"c{k}") if _orderable(kind) else F.to_json(F.struct(f"c{k}")) for k, kind in enumerate(inner.types)]
    where = ring(shards, nodes)
    owners = [s for _, s in where]
    # The arc of a position by bisection over the nodes, in an expression of bounded size: first
    # an equal-width cell, then the nodes inside it.
    position = F.pmod(F.xxhash64(comparable[int(inner.at(key_col)[1:])]), F.lit(1 << RING_BITS))
    cells = 1 << 12
    width = (1 << RING_BITS) // cells
    inside: list[list[int]] = [[] for _ in range(cells)]
    before, n = [0] * cells, 0
    for p, _ in where:
        inside[p // width].append(p)
    for c in range(cells):
        before[c] = n
        n += len(inside[c])
    lookup = F.broadcast(spark.createDataFrame([(c, before[c], inside[c]) for c in range(cells)], "cell int, before int, inside array<long>"))
    placed = written.withColumn("at", position).withColumn("cell", F.floor(F.col("at") / width).cast("int")).join(lookup, "cell")
    placed = placed.withColumn("arc", F.pmod(F.col("before") + F.size(F.filter("inside", lambda p: p < F.col("at"))), F.lit(len(where)))).drop("cell", "before", "inside")
    placed = placed.withColumn("print", F.xxhash64(*comparable))
    equal = placed.groupBy("print").count()
    total = written.count()
    # Less than SHARES rows, as each stands for more than that part of the table.
    many = equal.where((F.col("count") >= MANY) & (F.col("count") * SHARES > total)).select("print", (F.row_number().over(Window.orderBy("print")) * SALTS).cast("int").alias("own"))
    placed = placed.join(F.broadcast(cut(many)), "print", "left")
    salt = F.when(F.col("own").isNull(), F.col("print")).otherwise(F.col("place"))
    placed = placed.withColumn("part", F.coalesce("own", F.lit(0)) + F.pmod(salt, F.lit(SALTS)).cast("int"))
    # At most nodes * shards * SALTS counts, and SALTS for each of many.
    parts = sorted((r.arc, r.part, r["count"]) for r in placed.groupBy("arc", "part").count().collect())
    counts = [0] * len(where)
    ends: dict[int, list[tuple[int, int, int]]] = {}
    for arc, part, n in parts:
        ends.setdefault(arc, []).append((part, counts[arc], counts[arc] + n))
        counts[arc] += n
    # A slice of an arc is cut at the ends of the arc's parts: ranks within the part, and where they go.
    pieces = [
        (arc, part, max(first, a) - a, min(stop, b) - a, shard, slot + max(first, a) - first)
        for arc, first, stop, shard, slot in slices(counts, owners, capacities(sum(counts), shards))
        for part, a, b in ends[arc]
        if max(first, a) < min(stop, b)
    ]
    table_ = pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*pieces) if pieces else [[]] * 6, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["arc", "part", "first", "stop", "shard", "slot0"])
    order = Window.partitionBy("arc", "part").orderBy("at", *comparable)
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1)
    # Bounded by the ring: a piece for each part, and one more for each place where a shard fills.
    found = ranked.join(F.broadcast(spark.createDataFrame(table_)), ["arc", "part"]).where("rank >= first AND rank < stop")
    return found.select(*inner.outer(), "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))


def shard_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32; a null text counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_sizes(table(spark, sf_dir, "documents"))
    return shard_rows(rows, "doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
