"""Conversation prefix trie by heavy-path decomposition.

Every prefix of a conversation is a node. Its name comes from running
fingerprints along the conversation, so no conversation is gathered. The child
with the most members is a node's heavy one; all others are light and begin a
path of their own. A light child has at most half of its parent's members, so
no node lies below more light edges than the logarithm of the number of
conversations. Sums over subtrees go from the deepest paths up: in each round
the paths of one level are summed from their ends, and the sums at their heads
join the parents' own values, a level higher.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .along import along, met
from .session import cut, shared_folder, table

GROUP = 100
HEADS = 6
#: Ids that are joined to one piece of text before it is hashed.
PIECE_IDS = 10_000


def turn_print(role: Column, text: Column) -> Column:
    """A turn's MD5; a null role or text counts as empty."""
    return F.md5(F.concat(F.md5(F.coalesce(role, F.lit(""))), F.coalesce(text, F.lit(""))))


def numbered(turns: DataFrame) -> DataFrame:
    """conv, at, print, chars of a table conv, turn, print, chars: turns in order from 0, a null turn first, turns of one number by their print."""
    rows = turns.withColumn("one", F.lit(1).cast("long"))
    placed = along(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("print"), F.col("chars")], {"upto": ("sum", "one")})
    return placed.select("conv", (F.col("upto") - 1).alias("at"), "print", "chars")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations with the head of their group's first one in place of their own: turns (conv, at, print, chars) and conversations (conv, length).

    The head is the first crc32(conv) % heads turns of conversation conv - conv % group, or what there is of them.
    A group has at most 2 * group - 1 conversations and heads are short; only a conversation's own turns can be many.
    """
    sizes = cut(turns.groupBy("conv").agg(F.count("*").alias("own")))
    plan = sizes.select("conv", "own", (F.col("conv") - F.col("conv") % group).alias("first"), (F.crc32(F.col("conv").cast("string")) % heads).alias("h"))
    base = sizes.select(F.col("conv").alias("first"), F.col("own").alias("there"))
    plan = cut(plan.join(base, "first", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))))
    head = turns.where(F.col("at") < heads - 1).withColumnRenamed("conv", "first").join(plan.where("k > 0").select("conv", "first", "k"), "first").where("at < k").select("conv", "at", "print", "chars")
    total = sizes.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    moved = met(turns, plan.select("conv", "h", "k", "own"), ["conv"], "own", total).where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "print", "chars")
    lengths = plan.select("conv", (F.col("k") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("h"))).alias("length"))
    return cut(head.unionByName(moved)), lengths


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of ids, sorted by node and place, to one digest for each node; holds a digest's state, not the pieces."""
    key, state = None, None

    def ready() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=["depth", "conv_id", "ends_sha256"])

    for batch in batches:
        for depth, conv, piece in zip(*(batch[c].to_pylist() for c in ("depth", "conv_id", "piece"))):
            if (depth, conv) == key:
                state.update(b"," + piece.encode())
                continue
            if key is not None:
                yield ready()
            key, state = (depth, conv), hashlib.sha256(piece.encode())
    if key is not None:
        yield ready()


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, conv_id, ends_sha256 of the conversations (conv) that end at each node: their ids in order, joined by commas.

    A node's ids are numbered in their order and joined by pieces of PIECE_IDS; only pieces
    meet in a node's task, one after the other.
    """
    placed = along(ends.withColumn("one", F.lit(1).cast("long")), ["depth", "conv_id"], [F.col("conv")], {"upto": ("sum", "one")})
    piece = F.floor((F.col("upto") - 1) / PIECE_IDS).alias("k")
    joined = placed.groupBy("depth", "conv_id", piece).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("piece"))
    return joined.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "k").select("depth", "conv_id", "piece").mapInArrow(_digests, "depth long, conv_id long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, heavy, level.

    Turns go by number, a null one first; turns of one number by the MD5 of
    role and text. Null roles and texts are empty. Rows without an id belong
    to no conversation and are left out. Repeated rows are turns of their own.
    heads=1 leaves conversations as they are. conv_id is the smallest member; heavy tells whether a
    node continues its parent's path (the root doesn't), level how many light edges lie above it.
    An empty table gives an empty table; other columns are not read.
    """
    id_ = F.col(f"`{id_col}`").cast("long")
    turns = conversations.where(id_.isNotNull()).select(
        id_.alias("conv"), F.col(f"`{turn_col}`").alias("turn"), turn_print(F.col(f"`{role_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).alias("print"),
        F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("chars"),
    )
    rows, lengths = rebuilt(numbered(turns), group, heads)
    # Two fingerprints of the turn and its place; those of a prefix are put together by exclusive or. The root is depth 0.
    steps = rows.select("conv", (F.col("at") + 1).alias("depth"), "chars", F.xxhash64("print", "at").alias("x"), F.xxhash64(F.concat(F.lit("second "), "print"), "at").alias("y"))
    root = lengths.select("conv", *(F.lit(0).cast("long").alias(c) for c in ("depth", "chars", "x", "y")))
    walks = along(root.unionByName(steps), ["conv"], [F.col("depth")], {"a": ("bit_xor", "x"), "b": ("bit_xor", "y")})
    walks = walks.select("conv", "depth", "chars", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"))
    nodes = cut(walks.groupBy("depth", "a", "b").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.first("pa").alias("pa"), F.first("pb").alias("pb")))
    # The heavy child: most members, of equal ones that of the smallest member.
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", (-F.col("conv_id")).alias("least"))).alias("best"))
    named = nodes.join(children, ["depth", "a", "b"], "left").select("depth", "conv_id", "n_convs", "chars", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), (-F.col("best.least")).alias("heavy_child"), "a", "b", "pa", "pb")
    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy_child").alias("sibling"))
    tree = cut(named.join(parents, ["depth", "pa", "pb"], "left").select("depth", "a", "b", "conv_id", "n_convs", "chars", "n_children", "parent_conv_id", F.coalesce(F.col("sibling") == F.col("conv_id"), F.lit(False)).alias("heavy")))
    # A node's path is named by its head, the last node without a heavy edge above it on the way of any of its members.
    total = walks.count()
    flags = met(walks.select("conv", "depth", "a", "b"), tree.select("depth", "a", "b", "conv_id", "heavy", "n_convs"), ["depth", "a", "b"], "n_convs", total)
    at = F.when(F.col("heavy"), F.struct(F.lit(-1).cast("long").alias("head"), F.lit(0).cast("long").alias("path"))).otherwise(F.struct(F.col("depth").alias("head"), F.col("conv_id").alias("path")))
    flags = flags.select("conv", "depth", "conv_id", at.alias("at"), F.when(F.col("heavy") | (F.col("depth") == 0), 0).otherwise(1).cast("long").alias("light"))
    placed = along(flags, ["conv"], [F.col("depth")], {"top": ("max", "at"), "level": ("sum", "light")})
    ends = placed.groupBy("conv").agg(F.max("depth").alias("depth"), F.max_by("conv_id", "depth").alias("conv_id"))
    paths = placed.where("conv = conv_id").select("conv_id", "depth", "top.head", "top.path", "level")
    values = tree.join(paths, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "heavy", "level", "path", "head",
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    done = summed(values)
    digests = end_digests(ends)
    nothing = hashlib.sha256(b"").hexdigest()
    found = done.join(digests, ["depth", "conv_id"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "heavy", "level")


def summed(values: DataFrame) -> DataFrame:
    """Nodes with leaf and saved summed over their subtrees, as n_leaves and saved_tokens: a round for each level of paths, the deepest first."""
    spark = values.sparkSession
    folder = shared_folder(spark)
    values.write.partitionBy("level").parquet(folder)
    stored = spark.read.schema(values.schema).parquet(folder)
    deepest = stored.agg(F.max("level")).first()[0]
    done, light = None, None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        here = stored.where(F.col("level") == level)
        if light is not None:
            here = here.join(light, ["conv_id", "depth"], "left").withColumn("leaf", F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).drop("more_leaf", "more_saved")
        part = along(here.withColumn("up", -F.col("depth")), ["path", "head"], [F.col("up")], {"n_leaves": ("sum", "leaf"), "saved_tokens": ("sum", "saved")})
        done = part if done is None else done.unionByName(part)
        tops = part.where("depth = head AND depth > 0")
        light = tops.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("more_leaf"), F.sum("saved_tokens").alias("more_saved"))
    if done is None:
        done = values.withColumn("n_leaves", F.col("leaf")).withColumn("saved_tokens", F.col("saved"))
    return done


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = """
WITH t AS (
  SELECT conv_id AS c, md5(concat(md5(coalesce(role, '')), coalesce(text, ''))) AS p, CAST(len(coalesce(text, '')) AS BIGINT) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(md5(coalesce(role, '')), coalesce(text, '')))) - 1 AS at
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT c, count(*) AS own FROM t GROUP BY c
), plan AS (
  SELECT s.c, s.own, s.c - s.c % 100 AS base, s.h, least(s.h, coalesce(b.own, 0)) AS k
  FROM (SELECT *, xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda z: CAST(ord(z) AS BIGINT)), lambda a, b:
    list_reduce(range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)), 4294967295)) % 6 AS h FROM sizes) s LEFT JOIN sizes b ON b.c = s.c - s.c % 100
), r AS (
  SELECT plan.c, t.at + 1 AS d, t.p, t.chars FROM plan JOIN t ON t.c = plan.base AND t.at < plan.k
  UNION ALL SELECT plan.c, t.at - h + k + 1, t.p, t.chars FROM plan JOIN t ON t.c = plan.c AND t.at >= h
), w AS MATERIALIZED (
  SELECT c, 0 AS d, '' AS key, NULL AS up, CAST(0 AS BIGINT) AS chars FROM plan
  UNION ALL
  SELECT c, d, md5(string_agg(p, ',') OVER (PARTITION BY c ORDER BY d)),
    CASE WHEN d = 1 THEN '' ELSE md5(string_agg(p, ',') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END, chars FROM r
), n AS MATERIALIZED (
  SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(chars) AS chars FROM w GROUP BY d, key
), lasts AS (
  SELECT c, max(d) AS d FROM w GROUP BY c
), e AS (
  SELECT w.d, w.key, string_agg(CAST(w.c AS VARCHAR), ',' ORDER BY w.c) AS ids FROM w JOIN lasts USING (c, d) GROUP BY 1, 2
), f AS MATERIALIZED (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n m WHERE m.d = n.d + 1 AND m.up = n.key) AS n_children
  FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.key = n.up
), s AS (
  SELECT w.d, w.key, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved
  FROM f JOIN w ON w.c = f.conv_id AND w.d <= f.d GROUP BY 1, 2
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN s ON s.d = f.d AND s.key = f.key LEFT JOIN e ON e.d = f.d AND e.key = f.key
"""
