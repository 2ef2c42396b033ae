"""Biconnected blocks of a network, its articulation points, and exact betweenness block by block.

A spanning forest is toured; list ranking of the tour gives each node when it is
entered and left, and so its parent and subtree. The least and largest times
that a subtree's other edges reach come from minima over doubling ranges.
Tree edges that a cycle joins are linked, and the components of these links are
the blocks. All steps are joins in logarithmic rounds.

A path between two nodes of a block stays in it, so betweenness falls into sums
over the blocks, where each node stands for all that hangs on it outside, and
the pairs that an articulation point parts.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ranked
from .chains import follow
from .components import connected_components, graph_nodes, spanning_forest
from .paths import _search, relational_dependencies

#: Edges of a block that tasks hold; larger blocks are worked out by joins.
BLOCK_EDGES = 100_000
#: Sources times edges that one task takes of a block, about.
TASK_WORK = 20_000_000


def rooted_forest(tree: DataFrame) -> DataFrame:
    """id, parent, root, enter, leave, size of the nodes of a forest's edges (u, v); the root is the least node, its parent null.

    A node's subtree is what is entered from its own `enter` on and before its `leave`.
    """
    roots = cut(connected_components(tree).select(F.col("node").alias("id"), F.col("component").alias("root")))
    darts = tree.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(tree.select(F.col("v").alias("a"), F.col("u").alias("b")))
    placed = cut(ranked(darts.withColumn("dart", F.struct("a", "b")), "dart").select("a", "b", "rank"))
    # A dart into a node goes on by the node's next neighbour in order, from the last one to the first.
    ends = cut(placed.groupBy("a").agg(F.min("rank").alias("low"), F.max("rank").alias("high")))
    back = placed.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("rank").alias("back")).join(ends.withColumnRenamed("a", "b"), "b")
    then = back.withColumn("then", F.when(F.col("back") < F.col("high"), F.col("back") + 1).otherwise(F.col("low")))
    then = then.join(placed.select(F.col("rank").alias("then"), F.col("b").alias("onward")), "then").join(roots.withColumnRenamed("id", "b"), "b")
    # The tour ends where the root would be left by its first dart again.
    last = (F.col("b") == F.col("root")) & (F.col("back") == F.col("high"))
    tour = follow(then.select("a", "b", F.when(~last, F.col("onward")).alias("onward"), F.lit(1).cast("long").alias("left"), (F.col("a") == F.col("root")).alias("first")), ["left"])
    there = tour.select("a", "b", "left")
    again = tour.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("left").alias("left_back"))
    down = there.join(again, ["a", "b"]).where("left > left_back")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    down = down.select(F.col("b").alias("id"), F.col("a").alias("parent"), "left", "left_back").join(roots, "id").join(sizes, "root")
    steps = 2 * (F.col("n") - 1)
    inner = down.select("id", "parent", "root", (steps - F.col("left") + 1).alias("enter"), (steps - F.col("left_back") + 1).alias("leave"), ((F.col("left") - F.col("left_back") + 1) / 2).cast("long").alias("size"))
    tops = roots.where("id = root").join(sizes, "root").select("id", F.lit(None).cast("long").alias("parent"), "root", F.lit(0).cast("long").alias("enter"), (2 * F.col("n") - 1).alias("leave"), F.col("n").alias("size"))
    return cut(inner.unionByName(tops))


def subtree_reach(forest: DataFrame, values: DataFrame) -> DataFrame:
    """id, low, high: the least and the largest of values (id, low, high) over each node's subtree, by ranges of doubling length."""
    placed = cut(ranked(forest.select("id", "size", F.struct("root", "enter").alias("at")), "at").select("id", "size", "rank"))
    level = F.floor(F.log2("size") + 1e-9).cast("int")
    asked = cut(placed.select("id", "rank", "size", level.alias("level")))
    most = asked.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0]
    ranges = cut(placed.join(values, "id").select("rank", "low", "high"))
    found = None
    for k in range(most + 1):
        here = asked.where(F.col("level") == k)
        other = ranges.select(F.col("rank").alias("end"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        part = here.join(ranges, "rank").withColumn("end", F.col("rank") + F.col("size") - (1 << k)).join(other, "end")
        part = cut(part.select("id", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
        found = part if found is None else found.unionByName(part)
        if k < most:
            wider = ranges.withColumn("end", F.col("rank") + (1 << k)).join(other, "end", "left")
            ranges = cut(wider.select("rank", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
    return values.limit(0) if found is None else found


def blocks(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, v, w, block of each edge u < v, the shortest of parallel ones, loops left out; and the rooted forest with the block of each node's edge to its parent."""
    simple = cut(edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w")))
    tree = cut(spanning_forest(simple.withColumnRenamed("w", "dist")).select("u", "v"))
    forest = rooted_forest(tree)
    others = simple.join(tree, ["u", "v"], "left_anti")
    times = lambda end: forest.select(F.col("id").alias(end), F.col("enter").alias(f"enter_{end}"), F.col("leave").alias(f"leave_{end}"))
    timed = cut(others.join(times("u"), "u").join(times("v"), "v"))
    ends = timed.select(F.col("u").alias("id"), F.col("enter_v").alias("t")).unionByName(timed.select(F.col("v").alias("id"), F.col("enter_u").alias("t"))).unionByName(forest.select("id", F.col("enter").alias("t")))
    reach = subtree_reach(forest, ends.groupBy("id").agg(F.min("t").alias("low"), F.max("t").alias("high")))
    parents = forest.select(F.col("id").alias("parent"), F.col("enter").alias("p_enter"), F.col("leave").alias("p_leave"), F.col("parent").alias("above"))
    # An edge below a node that reaches out of the node's subtree closes a cycle with the node's own edge.
    out = forest.where("parent IS NOT NULL").join(reach, "id").join(parents, "parent").where("above IS NOT NULL AND (low < p_enter OR high > p_leave)").select(F.col("id").alias("u"), F.col("parent").alias("v"))
    apart = timed.where("NOT (enter_u <= enter_v AND enter_v <= leave_u) AND NOT (enter_v <= enter_u AND enter_u <= leave_v)").select("u", "v")
    named = connected_components(cut(out.unionByName(apart))).select(F.col("node").alias("id"), F.col("component").alias("block"))
    forest = cut(forest.join(named, "id", "left").withColumn("block", F.when(F.col("parent").isNotNull(), F.coalesce("block", "id"))))
    # The end that is entered later is no ancestor of the other one, so the edge is in the block of its own edge.
    late = simple.join(times("u"), "u").join(times("v"), "v").select("u", "v", "w", F.when(F.col("enter_u") > F.col("enter_v"), F.col("u")).otherwise(F.col("v")).alias("id"))
    return cut(late.join(forest.select("id", "block"), "id").select("u", "v", "w", "block")), forest


def branches(forest: DataFrame) -> DataFrame:
    """block, id, beyond, n: the members of each block, how many nodes of its component lie beyond the block seen from the member, and the component's nodes."""
    sizes = forest.where("parent IS NULL").select("root", F.col("size").alias("n"))
    below = forest.where("parent IS NOT NULL").groupBy("block", F.col("parent").alias("id")).agg(F.sum("size").alias("beyond"))
    own = forest.where("parent IS NOT NULL").select("id", "block", "root").join(sizes, "root")
    # All other branches of a node lie below it; what is left is beyond its own edge.
    elsewhere = below.withColumnRenamed("block", "other").join(own.select("id", "block"), "id").where("other <> block").groupBy("id").agg(F.sum("beyond").alias("elsewhere"))
    up = own.join(elsewhere, "id", "left").select("block", "id", (F.col("n") - 1 - F.coalesce("elsewhere", F.lit(0))).alias("beyond"), "n")
    # Where a block holds a node's own edge and edges below it, they are one branch.
    down = below.join(forest.select("id", F.col("block").alias("own"), "root"), "id").where("own IS NULL OR own <> block").join(sizes, "root").select("block", "id", "beyond", "n")
    return cut(up.unionByName(down))


def articulation_points(edges: DataFrame) -> DataFrame:
    """id, n_blocks: nodes whose removal parts their component, and into how many pieces."""
    _, forest = blocks(edges)
    return branches(forest).groupBy("id").agg(F.count("*").alias("n_blocks")).where("n_blocks > 1")


def _weighted(key: tuple, edges: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Dependencies inside a block on its share of the sources; members: id, hangs, mine."""
    near, total = defaultdict(list), defaultdict(float)
    for u, v, w in zip(edges["u"].tolist(), edges["v"].tolist(), edges["w"].tolist()):
        near[u].append((v, w))
        near[v].append((u, w))
    hangs = dict(zip(members["id"].tolist(), members["hangs"].tolist()))
    for source in members["id"][members["mine"]].tolist():
        _, order, paths, before = _search(near, source)
        share: dict = defaultdict(float)
        for node in reversed(order):
            for b in before[node]:
                share[b] += paths[b] / paths[node] * (hangs[node] + share[node])
            if node != source:
                total[node] += share[node] * hangs[source]
    return pd.DataFrame({"id": list(total), "score": list(total.values())})


def block_betweenness(edges: DataFrame, nodes: DataFrame | None = None, normalized: bool = True, block_edges: int = BLOCK_EDGES, task_work: int = TASK_WORK) -> DataFrame:
    """id, score as betweenness() gives them, worked out block by block: the searches of a node stay in its blocks.

    Blocks up to block_edges go to tasks, a share of their sources each; larger ones are worked out by joins.
    """
    nodes = cut(graph_nodes(edges) if nodes is None else nodes.select("id").union(graph_nodes(edges)).distinct())
    n = nodes.count()
    of, forest = blocks(edges)
    members = branches(forest)
    # Pairs that a node parts: of all pairs of other nodes those of different branches.
    parted = members.groupBy("id").agg(((F.pow(F.sum("beyond").cast("double"), 2) - F.sum(F.pow(F.col("beyond").cast("double"), 2)))).alias("score"))
    counts = of.groupBy("block").agg(F.count("*").alias("m")).where("m > 1")
    sized = members.withColumn("hangs", (F.col("n") - F.col("beyond")).cast("double")).join(counts, "block")
    shares = sized.groupBy("block").agg(F.first("m").alias("m"), F.ceil(F.count("*") * F.first("m") / task_work).cast("int").alias("shares"))
    shares = cut(shares)
    small = shares.where(F.col("m") <= block_edges)
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    left = salted(of.join(small.select("block", "shares"), "block")).select("block", "salt", "u", "v", "w")
    right = salted(sized.select("block", "id", "hangs").join(small.select(F.col("block").alias("b"), "shares"), F.col("block") == F.col("b"))).select(F.col("b").alias("of"), F.col("salt").alias("part"), "id", "hangs", (F.pmod(F.xxhash64("id"), F.col("shares")) == F.col("salt")).alias("mine"))
    scores = left.groupBy("block", "salt").cogroup(right.groupBy("of", "part")).applyInPandas(_weighted, "id long, score double").unionByName(parted)
    large = cut(shares.where(F.col("m") > block_edges).select("block"))
    if not large.isEmpty():
        # A node of two blocks is two nodes here.
        named = cut(cut(sized.join(large, "block", "left_semi").select("block", "id", "hangs")).withColumn("node", F.monotonically_increasing_id()))
        side = lambda end: named.select("block", F.col("id").alias(end), F.col("node").alias(f"n{end}"))
        inside = of.join(side("u"), ["block", "u"]).join(side("v"), ["block", "v"]).select(F.col("nu").alias("u"), F.col("nv").alias("v"), "w")
        found = relational_dependencies(cut(inside), named.select(F.col("node").alias("id")), named.select(F.col("node").alias("id"), "hangs"))
        scores = scores.unionByName(found.withColumnRenamed("id", "node").join(named, "node").select("id", "score"))
    scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 0.5
    totals = scores.groupBy("id").agg(F.sum("score").alias("score"))
    return nodes.join(totals, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * scale).alias("score"))
