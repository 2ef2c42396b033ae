"""Connected components and spanning forests as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", most_rounds: int = 60) -> DataFrame:
    """node, component: the least node that each node of edges reaches, by alternating large-star and small-star.

    Neighbourhoods are summed up to their least node, never gathered, so a hub
    costs no more than its edges. Self-loops only name their node.
    """
    links = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    lone = links.where("x = y").select(F.col("x").alias("node")).distinct()
    stars = cut(links.where("x <> y").distinct())
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(least.select("x", F.col("m").alias("y"))).distinct()
        stars = cut(small)
        # Done when every node has one smaller neighbour at most, and none if it is one.
        ends = stars.select("x", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(stars.select(F.col("y").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    found = stars.groupBy("x").agg(F.min("y").alias("component")).withColumnRenamed("x", "node").unionByName(stars.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
    rest = lone.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(rest)


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()


def labelled_nodes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, component; nodes (id) adds those without edges, each a component of its own."""
    labels = connected_components(edges).withColumnRenamed("node", "id")
    if nodes is None:
        return labels
    every = nodes.select("id").union(graph_nodes(edges)).distinct()
    return every.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def node_degree(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, degree; nodes (id) adds those without edges."""
    ends = edges.select(F.col("u").alias("id")).union(edges.select("v"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    if nodes is None:
        return degree
    return nodes.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def graph_summary(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, components; all 0 for an empty graph."""
    known = graph_nodes(edges) if nodes is None else nodes.select("id")
    labels = connected_components(edges).select(F.col("node").alias("id"), "component")
    per_node = known.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    counts = per_node.agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))
    return counts.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges")))).select("nodes", "edges", "components")


def _roots(choices: DataFrame, most_rounds: int = 60) -> DataFrame:
    """c, p: the root that each c reaches where every c chose p and only two that chose each other form a ring; the lesser of these is the root."""
    back = choices.select(F.col("c").alias("p"), F.col("p").alias("back"))
    now = choices.join(back, "p").select("c", F.when(F.col("back") == F.col("c"), F.least("c", "p")).otherwise(F.col("p")).alias("p"))
    for _ in range(most_rounds):
        for _ in range(2):
            now = now.join(now.select(F.col("c").alias("p"), F.col("p").alias("q")), "p").select("c", F.col("q").alias("p"))
        step = now.join(now.select(F.col("c").alias("p"), F.col("p").alias("q")), "p").select("c", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved"))
        step = cut(step)
        now = step.select("c", "p")
        if step.where("moved").isEmpty():
            return now
    raise RuntimeError("roots did not settle")


def spanning_forest(candidates: DataFrame, labels: DataFrame | None = None, most_rounds: int = 40) -> DataFrame:
    """The candidates (u, v, dist) of the minimum spanning forest in the order (dist, u, v), by Boruvka rounds.

    labels (node, component) merges nodes beforehand. The order is total, so the
    forest is the one that taking candidates in order, skipping those that
    close a cycle, would give.
    """
    open_ = cut(candidates.select("u", "v", "dist"))
    ends = open_.select(F.col("u").alias("node")).union(open_.select("v")).distinct()
    if labels is None:
        place = ends.select("node", F.col("node").alias("component"))
    else:
        place = ends.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    place = cut(place)
    taken = None
    for _ in range(most_rounds):
        left = place.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        right = place.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        across = cut(open_.join(left, "u").join(right, "v").where("cu <> cv"))
        both = across.select("cu", F.struct("dist", "u", "v", "cu", "cv").alias("e")).union(across.select("cv", F.struct("dist", "u", "v", "cu", "cv")))
        best = cut(both.groupBy("cu").agg(F.min("e").alias("e")))
        if best.isEmpty():
            break
        edges = best.select("e.u", "e.v", "e.dist").distinct()
        taken = edges if taken is None else taken.unionByName(edges)
        into = _roots(best.select(F.col("cu").alias("c"), F.when(F.col("e.cu") == F.col("cu"), F.col("e.cv")).otherwise(F.col("e.cu")).alias("p")))
        place = cut(place.join(into.withColumnRenamed("c", "component"), "component", "left").select("node", F.coalesce("p", "component").alias("component")))
        open_ = across.select("u", "v", "dist")
    return candidates.limit(0).select("u", "v", "dist") if taken is None else taken.distinct()


def merged_cells(edges: DataFrame, nodes: DataFrame, cell_nodes: int, most_rounds: int = 20) -> DataFrame:
    """id, cell: nodes (id) in cells of about cell_nodes neighbouring ones, as a network of edges (u, v) can be parted without places.

    In each round a cell of less than half that size joins a neighbour, the one of least hash; cells that choose each other in a chain become one.
    """
    place = cut(nodes.select("id", F.col("id").alias("cell")))
    for _ in range(most_rounds):
        size = cut(place.groupBy("cell").agg(F.count("*").alias("n")))
        across = edges.join(place.withColumnsRenamed({"id": "u", "cell": "cu"}), "u").join(place.withColumnsRenamed({"id": "v", "cell": "cv"}), "v").where("cu <> cv").select("cu", "cv").distinct()
        both = across.union(across.select("cv", "cu")).toDF("c", "p")
        draw = F.xxhash64(F.least("c", "p"), F.greatest("c", "p"))
        small = size.where(F.col("n") * 2 < cell_nodes).select(F.col("cell").alias("c"))
        # Choices go by one order of all pairs, so that only two that chose each other form a ring; who doesn't choose is a root.
        choice = both.join(small, "c", "left_semi").groupBy("c").agg(F.min(F.struct(draw.alias("draw"), "p"))["p"].alias("p"))
        choice = cut(choice)
        if choice.isEmpty():
            break
        still = choice.select(F.col("p").alias("c")).join(choice.select("c"), "c", "left_anti").distinct().select("c", F.col("c").alias("p"))
        into = _roots(choice.unionByName(still))
        place = cut(place.join(into.withColumnsRenamed({"c": "cell", "p": "root"}), "cell", "left").select("id", F.coalesce("root", "cell").alias("cell")))
    return place
