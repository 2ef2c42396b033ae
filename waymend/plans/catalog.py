"""The queries of the network and raster analysis over the test tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import around, blocks, chains, distance, epochs, labels, occlusion, overlay, simplify, ways
from ..operators import geometry as g
from ..operators import losses as lo
from ..operators import paths as p
from ..operators import raster as r
from ..operators import relational as rel
from ..operators.components import connected_components, graph_nodes, graph_summary, node_degree
from ..session import cut, rounded
from ..sources.graphml import read_graphml, write_graphml
from ..sources import synthetic as terrain
from .views import DENSE, SIDE, SPARSE, tile, view, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
WIDE = {"distance": 60.0, "angle": 90.0}
TOP_CLOSURES = 3
OD_PAIRS = 100
WAY_BOX = (12.9, 77.5, 13.2, 77.9)
#: Cells of the test tables' networks, which are small.
CELL_NODES = 32


def query(*names: str):
    """Register a function of DataFrames as a query over the named views."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(*views(spark, sf_dir, names))
        return fn

    return add


def table_query(name: str):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        return fn

    return add


query("broken_edges", "all_nodes")(graph_summary)


@query("edges")
def connected_components_(edges):
    return connected_components(edges)


QUERIES["connected_components"] = QUERIES.pop("connected_components_")
QUERIES["node_degree"] = lambda spark, d: node_degree(view(spark, d, "edges"), view(spark, d, "gpos").select("id"))


@query("broken_edges", "all_nodes")
def betweenness_with_lone_nodes(edges, nodes):
    return p.betweenness(edges, nodes).select("id", rounded(F.col("score")).alias("score"))


@query("edges")
def betweenness(edges):
    return p.betweenness(edges).select("id", rounded(F.col("score")).alias("score"))


@query("broken_edges", "all_nodes")
def betweenness_by_blocks(edges, nodes):
    return blocks.block_betweenness(edges, nodes).select("id", rounded(F.col("score")).alias("score"))


@query("broken_edges")
def articulation_points(edges):
    return blocks.articulation_points(edges)


@query("edges", "gpos")
def gatekeeper_topn(edges, gpos):
    top = p.gatekeepers(edges, p.betweenness(edges).withColumn("score", F.round("score", 9)), gpos)
    return top.select("id", rounded(F.col("score")).alias("score"), "degree", rounded(F.col("y")).alias("y"), rounded(F.col("x")).alias("x"), "is_endpoint")


@query("edges")
def top_gatekeeper(edges):
    best = p.betweenness(edges).withColumn("score", F.round("score", 9)).agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))
    return best.select("id", rounded(F.col("score")).alias("score"))


def busiest(edges: DataFrame, n: int = TOP_CLOSURES, network=None) -> DataFrame:
    return p.betweenness(edges, network=network).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(n).select(F.col("id").alias("closed"))


@query("edges")
def node_closure(edges):
    network = p.gathered(edges)
    done = p.node_closures(edges, busiest(edges, network=network), OD_PAIRS, network=network)
    return done.select(*(rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in done.dtypes))


@query("edges")
def od_sample(edges):
    return p.od_sample(edges, most_linked(edges), OD_PAIRS)


def most_linked(edges: DataFrame, n: int = 1) -> DataFrame:
    return node_degree(edges).orderBy(F.desc("degree"), "id").limit(n).select(F.col("id").alias("closed"))


@query("edges", "gpos")
def topological_accuracy(edges, gpos):
    return p.topological_accuracy(edges, gpos).select(rounded(F.col("mean_error_pct")).alias("mean_error_pct"), rounded(F.col("reachable_pct")).alias("reachable_pct"))


@query("broken_edges", "gpos", "edges", "all_nodes")
def topological_accuracy_of_truth(edges, gpos, truth, nodes):
    return p.topological_accuracy(edges, gpos, truth, nodes=nodes).select(rounded(F.col("mean_error_pct")).alias("mean_error_pct"), rounded(F.col("reachable_pct")).alias("reachable_pct"))


@query("broken_edges", "all_nodes")
def reachability(edges, nodes):
    every = edges.sparkSession.createDataFrame([(None,)], "closed long")
    return p.od_attempts(edges, every, 2 * OD_PAIRS, nodes).select("attempt", "u", "v", F.col("connected").alias("reachable"))


@query("edges")
def shortest_paths(edges):
    """How far all nodes are from each other."""
    return p.shortest_paths(edges, graph_nodes(edges).select(F.col("id").alias("src")))


@query("edges")
def overlay_distances(edges):
    """The same from the three most linked nodes, over cells and their borders."""
    return overlay.overlay_paths(edges, most_linked(edges, 3).select(F.col("closed").alias("src")), cell_nodes=CELL_NODES).select("src", "node", "dist")


@query("edges")
def overlay_closures(edges):
    """Trips of an OD sample where the most linked node is closed, over cells and their borders."""
    od = cut(p.od_sample(edges, most_linked(edges), OD_PAIRS))
    far = overlay.overlay_paths(edges, od.select("closed", F.col("u").alias("src")), od.select(F.col("v").alias("node")), cell_nodes=CELL_NODES)
    far = far.select("closed", F.col("src").alias("u"), F.col("node").alias("v"), F.col("dist").alias("after"))
    return od.join(far, ["closed", "u", "v"], "left").select("closed", "attempt", "u", "v", "after")


QUERIES["parallel_edge_min"] = lambda spark, d: rel.parallel_edge_min(view(spark, d, "multi_edges"))


@query("edges")
def affected_km(edges):
    return rel.affected_km(edges).select("id", rounded(F.col("km")).alias("km"))


@query("edges")
def node_removal(edges):
    return rel.node_removal(edges, most_linked(edges, 3))


@query("edges", "gpos")
def node_location(edges, gpos):
    return graph_nodes(edges).join(gpos, "id", "left").select("id", rounded(F.assert_true(F.col("y").isNotNull(), "a node has no place").isNull().cast("int") * F.col("y")).alias("y"), rounded(F.col("x")).alias("x"))


@query("edges", "gpos")
def edge_geometry(edges, gpos):
    return rel.edge_geometry(edges, gpos).select("u", "v", *(rounded(F.col(c)).alias(c) for c in ("yu", "xu", "yv", "xv")))


@query("edges")
def edge_style(edges):
    return rel.edge_style(edges, most_linked(edges))


@query("edges")
def node_style(edges):
    closed = most_linked(edges).select(F.col("closed").alias("id"), F.lit(True).alias("c"))
    critical = most_linked(edges, 5).select(F.col("closed").alias("id"), F.lit(True).alias("k"))
    nodes = graph_nodes(edges).join(closed, "id", "left").join(critical, "id", "left")
    return rel.node_style(nodes.select("id", F.coalesce("c", F.lit(False)).alias("is_closed"), F.coalesce("k", F.lit(False)).alias("is_critical")))


@table_query("lineitem")
def kpi_flags(lineitem):
    rows = lineitem.select("l_orderkey", "l_linenumber", (1 - F.col("l_discount") * 3).alias("resilience_index"), (F.col("l_tax") * 100).alias("travel_time_impact_pct"))
    return rel.kpi_flags(rows).select("l_orderkey", "l_linenumber", "index_low", "impact_high")


@table_query("customer")
def validate_location(customer):
    lat, lon, radius = F.col("c_acctbal") / 100, (F.col("c_custkey") % 400 - 200).cast("double"), (F.col("c_custkey") * 7 % 6000).cast("double")
    return customer.select("c_custkey", rel.valid_location(lat, lon, radius).alias("valid"))


@table_query("lineitem")
def binarize_threshold(lineitem):
    scores = lineitem.groupBy(F.expr(tile(DENSE)).alias("tile_id"), (F.col("l_partkey") % SIDE).cast("int").alias("y"), (F.col("l_orderkey") % SIDE).cast("int").alias("x"))
    return r.binarize(scores.agg(F.max("l_discount").alias("p")).withColumn("p", F.when(F.col("tile_id") % 2 == 0, F.col("p") * 10).otherwise(F.col("p") * 2550)))


def _image(lineitem: DataFrame, k: int) -> DataFrame:
    cell = lineitem.groupBy(F.expr(tile(SPARSE)).alias("tile_id"), (F.col("l_partkey") % SIDE).cast("int").alias("y"), (F.col("l_orderkey") % SIDE).cast("int").alias("x"))
    return cell.agg(*(((F.sum(F.col(c)) * k) % 256).cast("int").alias(n) for n, c in (("r", "l_partkey"), ("g", "l_suppkey"), ("b", "l_orderkey"))))


@table_query("lineitem")
def occlusion_mask(lineitem):
    return r.occlusion_mask(_image(lineitem, 1), _image(lineitem, 2), 60.0)


QUERIES["overlay_roads"] = lambda spark, d: r.overlay_roads(_image(spark.read.parquet(f"{d}/lineitem.parquet"), 1), view(spark, d, "mask"))


@query("mask")
def mask_summary(mask):
    return mask.groupBy("tile_id").agg(F.count("*").alias("road_pixels"))


@query("mask", "pred")
def mask_set_ops(mask, pred):
    named = lambda df, n: df.select(F.lit(n).alias("op"), *r.PIXEL)
    return named(mask.intersect(pred), "and").union(named(mask.union(pred).distinct(), "or")).union(named(mask.exceptAll(pred), "minus"))


@table_query("customer")
def geo_to_pixel(customer):
    points = customer.select("c_custkey", (F.col("c_acctbal") / 100).alias("lat"), (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"))
    return rel.geo_to_pixel(points, (-90.0, -180.0, 90.0, 180.0), 512, 512).select("c_custkey", "py", "px")


@table_query("orders")
def positional_split(orders):
    return rel.positional_split(orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", ["o_totalprice", "o_orderkey"]).select("o_orderkey", "split")


@table_query("events")
def running_best(events):
    return rel.running_best(events.select("event_id", "user_id", "value"), "user_id", "event_id", "value").select("event_id", "is_best")


@query("broken_edges", "gpos")
def endpoint_trajectory(edges, gpos):
    return g.endpoint_trajectory(edges, gpos).select("id", rounded(F.col("dy")).alias("dy"), rounded(F.col("dx")).alias("dx"))


@table_query("embeddings")
def angular_deviation(embeddings):
    part = [F.element_at("embedding", k).cast("double") for k in (1, 2, 3, 4)]
    a, b = g.norm(part[0], part[1]), g.norm(part[2], part[3])
    return embeddings.select("vec_id", F.round(g.angle_between(part[0] / a, part[1] / a, part[2] / b, part[3] / b), 4).alias("degrees"))


@query("broken_edges", "gpos")
def endpoint_range_join(edges, gpos):
    ends = node_degree(edges).where("degree = 1").join(gpos, "id")
    return g.range_join(ends, 60.0).select("u", "v", rounded(F.col("dist")).alias("dist"))


def _bridges(df: DataFrame, dist: str = "dist") -> DataFrame:
    return df.select("u", "v", rounded(F.col(dist)).alias("dist"), F.round("angle_u", 4).alias("angle_u"), F.round("angle_v", 4).alias("angle_v"))


@query("broken_edges", "gpos")
def candidate_bridges(edges, gpos):
    return _bridges(g.candidate_bridges(edges, gpos, **WIDE))


@query("broken_edges", "gpos", "all_nodes")
def heal_bridges(edges, gpos, nodes):
    return _bridges(g.heal_bridges(edges, gpos, **WIDE, nodes=nodes), "length_px")


@query("broken_edges", "gpos", "all_nodes")
def heal_bridges_narrow(edges, gpos, nodes):
    return _bridges(g.heal_bridges(edges, gpos, nodes=nodes), "length_px")


@query("broken_edges", "gpos", "all_nodes")
def heal_bridges_strict(edges, gpos, nodes):
    return _bridges(g.heal_bridges(edges, gpos, **WIDE, mode="strict", nodes=nodes), "length_px")


@query("edges", "gpos")
def heal_bridges_of_one_component(edges, gpos):
    return _bridges(g.heal_bridges(edges, gpos, distance=1000.0, angle=180.0), "length_px")


@query("broken_edges", "gpos", "all_nodes")
def heal_summary(edges, gpos, nodes):
    return g.heal_summary(g.heal(edges, gpos, **WIDE, nodes=nodes))


@query("broken_edges", "gpos", "all_nodes")
def connectivity_ratio(edges, gpos, nodes):
    done = g.heal(edges, gpos, **WIDE, nodes=nodes)
    found = g.connectivity_of(done.labels, cut(done.labels_after()))
    return found.select("largest_before", "largest_after", rounded(F.col("connectivity_gain")).alias("connectivity_gain"), rounded(F.col("connectivity_coverage")).alias("connectivity_coverage"))


query("mask")(r.pixel_adjacency)
query("mask")(r.pixel_classify)
query("mask")(labels.component_area_filter)
query("mask")(labels.pixel_components)
query("mask")(r.thinning_step)
query("mask")(r.skeletonize)
query("mask")(r.skeleton_nodes)


@query("mask")
def mask_dilate(mask):
    return r.dilate(mask, r.ellipse(4), SIDE, SIDE)


@query("pred", "mask")
def mask_iou_dice(pred, mask):
    return r.mask_iou_dice(pred, mask).select("tile_id", rounded(F.col("iou")).alias("iou"), rounded(F.col("dice")).alias("dice"))


@query("pred", "mask")
def mask_relaxed_iou(pred, mask):
    return r.mask_relaxed_iou(pred, mask, 4, SIDE, SIDE).select("tile_id", rounded(F.col("relaxed_iou")).alias("relaxed_iou"))


@query("pred", "mask")
def relaxed_ious(pred, mask):
    return distance.relaxed_ious(pred, mask, [0, 1, 2, 4, 8], SIDE, SIDE).select("tile_id", "tolerance", rounded(F.col("relaxed_iou")).alias("relaxed_iou"))


@query("pred", "mask")
def distance_to_mask(pred, mask):
    return distance.distance_to(pred, mask, SIDE, SIDE).select(*r.PIXEL, "d2")


@query("pred", "mask", "occ")
def occlusion_recall(pred, mask, occ):
    return r.occlusion_recall(pred, mask, occ).select("tile_id", rounded(F.col("recall")).alias("recall"))


@query("mask")
def extract_patches(mask):
    return r.extract_patches(mask, SIDE, SIDE, 32, 8)


@query("mask")
def stitch_patches(mask):
    return r.stitch_patches(r.extract_patches(mask, SIDE, SIDE, 32, 8), SIDE, SIDE, 32, 8)


@query("mask")
def punch_hole(mask):
    return r.punch_hole(mask, SIDE // 2, SIDE // 2, 15)


@query("mask")
def flip_rotate(mask):
    return r.flip_rotate(mask, SIDE, SIDE)


@query("mask")
def morph_skeleton(mask):
    return r.morph_skeleton(mask, SIDE, SIDE)


@query("mask")
def skeleton_graph(mask):
    return chains.skeleton_graph(mask).select("u", "v", rounded(F.col("weight")).alias("weight"), rounded(F.col("length_px")).alias("length_px"))


@query("mask")
def skeleton_paths(mask):
    return chains.path_points(chains.skeleton_graph(mask))


@table_query("lineitem")
def polyline_length(lineitem):
    points = lineitem.select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 97).cast("double").alias("y"), (F.col("l_suppkey") % 89).cast("double").alias("x"))
    return rel.polyline_length(points).select("path_id", rounded(F.col("length")).alias("length"))


@table_query("lineitem")
def rasterize_ways(lineitem):
    points = lineitem.select(F.expr(tile(SPARSE)).alias("tile_id"), F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("pos"), (F.col("l_orderkey") % 48 + F.col("l_suppkey") % 16).alias("y"), (F.col("l_linenumber") * 9 - 8).alias("x"))
    return r.rasterize_ways(points, SIDE, SIDE, 3)


@table_query("lineitem")
def normalise(lineitem):
    return r.normalise(_image(lineitem, 1)).select(*r.PIXEL, *(rounded(F.col(c)).alias(c) for c in "rgb"))


@table_query("lineitem")
def swap_channels(lineitem):
    return r.swap_channels(_image(lineitem, 1))


@table_query("lineitem")
def augment(lineitem):
    return r.augment(_image(lineitem, 1), SIDE, SIDE)


def _tinted(dense: DataFrame) -> DataFrame:
    """An image of every dense tile."""
    return dense.select(*r.PIXEL, F.floor(F.col("p") * 250).cast("int").alias("r"), (F.col("y") * 2 + 90).cast("int").alias("g"), (F.col("x") * 3 + F.col("t") * 40).cast("int").alias("b"))


@query("dense")
def occlusion_shapes(dense):
    """The filled shadow polygons of every tile."""
    shadows = occlusion.shapes(dense, "shadow", 3, SIDE, SIDE)
    return occlusion.filled_polygons(occlusion.polygon_corners(shadows), SIDE, SIDE)


@query("dense")
def occlude(dense):
    return occlusion.occlude(_tinted(dense), SIDE, SIDE)


@query("dense")
def occluded_variants(dense):
    return occlusion.occluded_variants(_tinted(dense), SIDE, SIDE)


@query("mask", "pred")
def side_by_side(mask, pred):
    return r.side_by_side([r.gray_to_rgb(mask), r.gray_to_rgb(pred, 127)], SIDE)


@query("dense")
def gaussian_blur(dense):
    return r.gaussian_blur(dense, ["p"], SIDE, SIDE).select(*r.PIXEL, rounded(F.col("p")).alias("p"))


@query("dense")
def resize(dense):
    return r.resize(dense.withColumn("p", F.sqrt("p")), ["p"], SIDE, SIDE, 24, 40).select(*r.PIXEL, rounded(F.col("p")).alias("p"))


@table_query("lineitem")
def epoch_means(lineitem):
    return rel.epoch_means(lineitem.select(F.col("l_linenumber").alias("epoch"), F.col("l_discount").alias("loss"), F.col("l_quantity").alias("n"))).select("epoch", rounded(F.col("loss")).alias("loss"))


@query("dense")
def gaussian_blur_wide(dense):
    return r.gaussian_blur(dense, ["p", "t"], SIDE, SIDE, 51, 0.0).select(*r.PIXEL, rounded(F.col("p")).alias("p"), rounded(F.col("t")).alias("t"))


@table_query("part")
def epoch_batches(part):
    return epochs.epoch_batches(part, "p_partkey", 3, 64)


@table_query("supplier")
def ways_to_tiles(supplier):
    """Each four suppliers are a way over 16 x 16 tiles; some of them lie outside."""
    lat, lon = 12.89 + F.col("s_suppkey") * 37 % 101 / 101.0 * 0.32, 77.49 + F.col("s_suppkey") * 53 % 97 / 97.0 * 0.42
    points = supplier.select(F.floor(F.col("s_suppkey") / 4).alias("way_id"), F.col("s_suppkey").alias("pos"), lat.alias("lat"), lon.alias("lon"))
    return ways.ways_to_tiles(points, WAY_BOX, SIDE, 16, 16, 3)


@table_query("part")
def sample_rows(part):
    return rel.sample_rows(part, "p_partkey", 5).select("p_partkey", "p_name")


@table_query("lineitem")
def synthetic_road_mask(lineitem):
    return r.synthetic_road_mask(_dense_tiles(lineitem), SIDE, SIDE)


@table_query("lineitem")
def synthetic_tiles(lineitem):
    return terrain.synthetic_tiles(_dense_tiles(lineitem), SIDE, SIDE)


def _dense_tiles(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.expr(tile(DENSE)).alias("tile_id")).distinct()


def _side(supplier: DataFrame) -> int:
    """The side of the largest square lattice that the suppliers fill."""
    return math.isqrt(supplier.count())


@query("multi_edges", "all_nodes")
def network_around(ways, nodes):
    places = nodes.select("id", (12.97 + F.floor(F.col("id") / 10) * 0.003).alias("lat"), (77.59 + F.col("id") % 10 * 0.003).alias("lon"))
    return around.network_around(ways, places, 12.985, 77.605, 1500.0)


@table_query("supplier")
def grid_places(supplier):
    return terrain.grid_places(supplier.sparkSession, _side(supplier)).select("id", rounded(F.col("lat")).alias("lat"), rounded(F.col("lon")).alias("lon"))


@table_query("supplier")
def grid_graph(supplier):
    return terrain.grid_graph(supplier.sparkSession, _side(supplier))


def _one_ways(edges: DataFrame) -> DataFrame:
    """Each edge both ways, but for every third length: one way."""
    there = edges.select("u", "v", F.col("w").alias("length"))
    return there.unionByName(there.where("length % 3 <> 0").select(F.col("v").alias("u"), F.col("u").alias("v"), "length"))


@query("broken_edges")
def street_ends(edges):
    return simplify.street_ends(_one_ways(edges))


@query("broken_edges")
def simplified_streets(edges):
    return simplify.simplified(_one_ways(edges))


def _rounded_all(df: DataFrame) -> DataFrame:
    return df.select(*(rounded(F.col(c)).alias(c) for c in df.columns))


for _loss in (lo.dice_loss, lo.bce_loss, lo.boundary_loss, lo.connectivity_loss, lo.composite_loss):
    QUERIES[_loss.__name__] = lambda spark, d, _loss=_loss: _rounded_all(_loss(view(spark, d, "dense")))


@query("dense")
def sobel_edges(dense):
    return lo.sobel_edges(dense, ["p", "t"]).select(*r.PIXEL, rounded(F.col("edge_p")).alias("edge_p"), rounded(F.col("edge_t")).alias("edge_t"))


@query("dense")
def laplacian(dense):
    return lo.convolve(dense, ["p", "t"], {"lap": lo.LAPLACIAN}).select(*r.PIXEL, (rounded(F.col("lap_p")) + F.lit(0.0)).alias("lap_p"), (rounded(F.col("lap_t")) + F.lit(0.0)).alias("lap_t"))


def graphml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, gpos = views(spark, sf_dir, ("edges", "gpos"))
    nodes = graph_nodes(edges).join(gpos, "id").join(node_degree(edges), "id").select("id", "y", "x", (F.col("degree") <= 1).alias("is_endpoint"))
    full = edges.select("u", "v", F.col("w").cast("double").alias("weight"), (F.col("w") / 10).alias("length_px"), F.lit(False).alias("healed"))
    _, back = read_graphml(spark, write_graphml(nodes, full))
    return back.select("u", "v", rounded(F.col("weight")).alias("weight"), rounded(F.col("length_px")).alias("length_px"), "healed")


QUERIES["graphml_roundtrip"] = graphml_roundtrip
