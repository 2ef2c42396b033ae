"""Spatial joins and bridges between loose ends of a network."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import connected_components, labelled_nodes, node_degree, spanning_forest


def norm(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def angle_between(ay: Column, ax: Column, by: Column, bx: Column) -> Column:
    """Degrees between two unit vectors; a zero vector gives 90."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ay * by + ax * bx))))


def range_join(points: DataFrame, radius: float) -> DataFrame:
    """u, v, dist of all pairs of points (id, y, x) with u < v at most radius apart.

    Points meet only in cells of the radius' size: one side stands in its own
    cell, the other in the nine around it, so each pair meets once, as an equi-join.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    left = points.select(F.col("id").alias("u"), F.col("y").alias("yu"), F.col("x").alias("xu"), cell("y").alias("cy"), cell("x").alias("cx"))
    around = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    right = points.select(F.col("id").alias("v"), F.col("y").alias("yv"), F.col("x").alias("xv"), F.explode(around).alias("d")).select("v", "yv", "xv", (F.floor(F.col("yv") / radius) + F.col("d.dy")).alias("cy"), (F.floor(F.col("xv") / radius) + F.col("d.dx")).alias("cx"))
    dist = norm(F.col("yu") - F.col("yv"), F.col("xu") - F.col("xv"))
    return left.join(right, ["cy", "cx"]).where("u < v").withColumn("dist", dist).where(F.col("dist") <= radius).select("u", "v", "dist", "yu", "xu", "yv", "xv")


def endpoint_trajectory(edges: DataFrame, places: DataFrame) -> DataFrame:
    """id, dy, dx: the unit vector from its only neighbour to each node of degree 1; zero where they are less than 1e-6 apart."""
    ends = node_degree(edges).where("degree = 1").select("id")
    near = edges.select(F.col("u").alias("id"), F.col("v").alias("other")).union(edges.select("v", "u"))
    at = places.select("id", "y", "x")
    both = ends.join(near, "id").join(at, "id").join(at.select(F.col("id").alias("other"), F.col("y").alias("yo"), F.col("x").alias("xo")), "other")
    dy, dx = F.col("y") - F.col("yo"), F.col("x") - F.col("xo")
    size = norm(dy, dx)
    return both.select("id", "y", "x", F.when(size < 1e-6, 0.0).otherwise(dy / size).alias("dy"), F.when(size < 1e-6, 0.0).otherwise(dx / size).alias("dx"))


def candidate_bridges(edges: DataFrame, places: DataFrame, distance: float = 30.0, angle: float = 45.0) -> DataFrame:
    """u, v, dist, angle_u, angle_v: pairs of loose ends in range that both point at each other within the angle."""
    ways = endpoint_trajectory(edges, places)
    pairs = range_join(ways, distance)
    pairs = pairs.join(ways.select(F.col("id").alias("u"), F.col("dy").alias("duy"), F.col("dx").alias("dux")), "u").join(ways.select(F.col("id").alias("v"), F.col("dy").alias("dvy"), F.col("dx").alias("dvx")), "v")
    size = F.greatest("dist", F.lit(1e-6))
    by, bx = (F.col("yv") - F.col("yu")) / size, (F.col("xv") - F.col("xu")) / size
    pairs = pairs.withColumn("angle_u", angle_between(F.col("duy"), F.col("dux"), by, bx)).withColumn("angle_v", angle_between(F.col("dvy"), F.col("dvx"), -by, -bx))
    return pairs.where((F.col("angle_u") <= angle) & (F.col("angle_v") <= angle)).select("u", "v", "dist", "angle_u", "angle_v")


@dataclass
class Healing:
    """What mending a network gives: bridges, the candidates looked at, and the network's components (id, component) before."""

    bridges: DataFrame
    candidates: DataFrame
    labels: DataFrame

    def labels_after(self) -> DataFrame:
        """id, component with the bridges: only components that bridges meet are put together, the network is not labelled again."""
        ends = self.bridges.select("u", "v").join(self.labels.toDF("u", "cu"), "u").join(self.labels.toDF("v", "cv"), "v")
        merged = connected_components(ends.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).toDF("component", "merged")
        return self.labels.join(merged, "component", "left").select("id", F.coalesce("merged", "component").alias("component"))


def heal_bridges(edges: DataFrame, places: DataFrame, distance: float = 30.0, angle: float = 45.0, scale: float = 10.0, mode: str = "reference", nodes: DataFrame | None = None) -> DataFrame:
    """The bridges that mend the network: u, v, weight, length_px, healed, angle_u, angle_v; see heal()."""
    return heal(edges, places, distance, angle, scale, mode, nodes).bridges


def heal(edges: DataFrame, places: DataFrame, distance: float = 30.0, angle: float = 45.0, scale: float = 10.0, mode: str = "reference", nodes: DataFrame | None = None) -> Healing:
    """The bridges that mend the network: u, v, weight, length_px, healed, angle_u, angle_v.

    A network of one component, or of none, needs none. nodes (id) adds those
    without edges, each a component of its own.

    mode "reference": bridges form a minimum spanning forest of the candidates
    alone, so one may close a cycle within a component. mode "strict": only
    bridges between different components of the network.
    """
    if mode not in ("reference", "strict"):
        raise ValueError(f"mode is reference or strict, not {mode}")
    labels = cut(labelled_nodes(edges, nodes))
    every = found = cut(candidate_bridges(edges, places, distance, angle))
    if len(labels.select("component").distinct().limit(2).collect()) < 2:
        found = cut(found.limit(0))
    forest = spanning_forest(found, labels.withColumnRenamed("id", "node") if mode == "strict" else None)
    bridges = forest.join(found, ["u", "v", "dist"]).select("u", "v", (F.col("dist") * scale).alias("weight"), F.col("dist").alias("length_px"), F.lit(True).alias("healed"), "angle_u", "angle_v")
    return Healing(cut(bridges), every, labels)


def heal_summary(done: Healing) -> DataFrame:
    """One row: healed_edges_added, components_before, components_after, candidate_bridges_evaluated."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = lambda labels, name: labels.agg(F.countDistinct("component").alias(name))
    added = count(done.bridges, "healed_edges_added").crossJoin(parts(done.labels, "components_before")).crossJoin(parts(done.labels_after(), "components_after"))
    return added.crossJoin(count(done.candidates, "candidate_bridges_evaluated"))


def largest_component(labels: DataFrame) -> DataFrame:
    """One row: the size of the largest component of labels (id, component), and n, the number of nodes."""
    return labels.groupBy("component").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("largest"), F.coalesce(F.sum("count"), F.lit(0)).alias("n"))


def connectivity_ratio(raw: DataFrame, healed: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row: largest component before and after, connectivity_gain, connectivity_coverage. nodes (id) adds those without edges."""
    return connectivity_of(cut(labelled_nodes(raw, nodes)), cut(labelled_nodes(healed, nodes)))


def connectivity_of(labels: DataFrame, healed: DataFrame) -> DataFrame:
    """The same from labels (id, component) before and after."""
    before = largest_component(labels).select(F.col("largest").alias("largest_before"))
    after = largest_component(healed).withColumnRenamed("largest", "largest_after")
    return before.crossJoin(after).select(
        "largest_before", "largest_after", (F.col("largest_after") / F.greatest("largest_before", F.lit(1))).alias("connectivity_gain"), (F.col("largest_after") / F.greatest("n", F.lit(1))).alias("connectivity_coverage")
    )
