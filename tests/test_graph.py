"""Networks small enough to work out by hand."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from waymend import session
from waymend.operators import around, geometry, paths, relational
from waymend.operators.components import connected_components, graph_summary, labelled_nodes, node_degree, spanning_forest
from waymend.plans import catalog, oracles

EDGES = "u long, v long, w long"
PLACES = "id long, y double, x double"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def broken(spark):
    places = [(0, 10.0, 10.0), (1, 10.0, 45.0), (2, 10.0, 55.0), (3, 10.0, 90.0), (4, 80.0, 80.0), (5, 80.0, 90.0), (6, 20.0, 50.0), (7, 50.0, 50.0)]
    return spark.createDataFrame([(0, 1, 350), (2, 3, 350), (4, 5, 100), (6, 7, 300)], EDGES), spark.createDataFrame(places, PLACES)


@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_heal_only_the_aligned_gap(spark, broken, mode):
    edges, places = broken
    healed = geometry.heal_bridges(edges, places, mode=mode).collect()
    assert [(r.u, r.v, r.weight, r.healed) for r in healed] == [(1, 2, 100.0, True)]
    joined = edges.select("u", "v").union(geometry.heal_bridges(edges, places, mode=mode).select("u", "v"))
    assert (graph_summary(edges).first().components, graph_summary(joined).first().components) == (4, 3)


def test_heal_mode_is_checked(broken):
    with pytest.raises(ValueError):
        geometry.heal_bridges(*broken, mode="other")


def test_range_join_meets_each_pair_once(spark):
    points = [(k, (k * 37 % 101) / 3, (k * 53 % 97) / 3) for k in range(120)]
    found = rows(geometry.range_join(spark.createDataFrame(points, PLACES), 5.0).select("u", "v"))
    want = sorted((a[0], b[0]) for a in points for b in points if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 5.0)
    assert found == want


def test_connectivity_ratio(spark):
    before = spark.createDataFrame([(0, 1, 1), (2, 3, 1)], EDGES)
    after = spark.createDataFrame([(0, 1, 1), (2, 3, 1), (1, 2, 1)], EDGES)
    assert tuple(geometry.connectivity_ratio(before, after).first()) == (2, 4, 2.0, 1.0)


def test_star_hub(spark):
    star = spark.createDataFrame([(0, k, 10) for k in range(1, 5)], EDGES)
    scores = dict(rows(paths.betweenness(star)))
    assert scores == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_relational_betweenness_agrees(spark):
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 2), (0, 3, 1), (3, 2, 3), (2, 4, 1), (4, 5, 2), (1, 5, 5), (7, 8, 1), (8, 9, 1)], EDGES)
    nodes = edges.select("u").union(edges.select("v")).distinct().withColumnRenamed("u", "id")
    n = nodes.count()
    fast = dict(rows(paths.betweenness(edges)))
    slow = {}
    for r in paths.relational_dependencies(edges, nodes).collect():
        slow[r.id] = slow.get(r.id, 0) + r.score / ((n - 1) * (n - 2))
    assert {k: pytest.approx(v) for k, v in fast.items() if v} == {k: v for k, v in slow.items() if v > 1e-12}


def test_relaxed_paths_agree(spark):
    edges = spark.createDataFrame([(0, 1, 7), (1, 2, 2), (0, 2, 20), (2, 3, 1), (5, 6, 1)], EDGES)
    sources = spark.createDataFrame([(0,), (5,)], "src long")
    assert rows(paths.shortest_paths(edges, sources)) == rows(paths.relaxed_paths(edges, sources)) == [(0, 0, 0), (0, 1, 7), (0, 2, 9), (0, 3, 10), (5, 5, 0), (5, 6, 1)]


def test_shortest_paths_query_starts_from_every_node(spark, tmp_path):
    """Two rings of suppliers, 14 and 3: each node is as far from all of its ring as the SQL says, and searches are dealt to several tasks."""
    rings = [[*range(1, 15)], [21, 22, 23]]
    near = [(r[k], r[(k + 1) % len(r)]) for r in rings for k in range(len(r))]
    lines = [(order, supplier, 1.0 + order) for order, pair in enumerate(near) for supplier in pair]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.QUERIES["shortest_paths"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = rows(found)
    assert got == sorted(con.execute(oracles.SQL["shortest_paths"]).fetchall())
    assert [(s, n) for s, n, _ in got] == sorted((a, b) for r in rings for a in r for b in r)
    assert len(set(r[0] for r in found.select(F.spark_partition_id()).collect())) > 1


def test_diamond_closure(spark):
    edges = spark.createDataFrame([(0, 1, 10), (1, 3, 10), (0, 2, 10), (2, 3, 10)], EDGES)
    r = paths.node_closures(edges, spark.createDataFrame([(1,)], "closed long"), 10).first()
    assert (r.resilience_index, r.travel_time_impact_pct, r.disconnected, r.disconnected_pair_count, r.affected_segment_length_km) == (1.0, 0.0, False, 0, 0.02)


def test_line_closure_severs_all(spark):
    edges = spark.createDataFrame([(0, 1, 15), (1, 2, 15)], EDGES)
    r = paths.node_closures(edges, spark.createDataFrame([(1,)], "closed long"), 5).first()
    assert (r.disconnected, r.disconnected_pair_count, r.total_pairs_evaluated, r.resilience_index) == (True, 5, 5, 0.0)
    assert math.isinf(r.travel_time_impact_pct) and r.perturbed_avg_length_m == 150.0


def test_closure_of_a_pair(spark):
    r = paths.node_closures(spark.createDataFrame([(0, 1, 15)], EDGES), spark.createDataFrame([(1,)], "closed long"), 5).first()
    assert (r.resilience_index, r.disconnected, r.total_pairs_evaluated) == (0.0, True, 0)


def test_components_of_loops_and_nothing(spark):
    assert rows(connected_components(spark.createDataFrame([(4, 4, 1), (5, 3, 1), (3, 9, 1)], EDGES))) == [(3, 3), (4, 4), (5, 3), (9, 3)]
    empty = spark.createDataFrame([], EDGES)
    assert tuple(graph_summary(empty).first()) == (0, 0, 0)


def test_components_match_union_find(spark):
    pairs = [(k * 7 % 61, k * 13 % 67, 1) for k in range(40)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b, _ in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert dict(rows(connected_components(spark.createDataFrame(pairs, EDGES)))) == {k: find(k) for k in list(root)}


def test_components_of_a_path_that_runs_up_and_down(spark):
    """After a round node 3 has two smaller neighbours, and no node both has one and is one."""
    edges = spark.createDataFrame([(1, 4, 1), (4, 3, 1), (3, 5, 1), (5, 2, 1)], EDGES)
    assert rows(connected_components(edges)) == [(k, 1) for k in range(1, 6)]
    assert tuple(graph_summary(edges).first()) == (5, 4, 1)


def test_components_of_shuffled_paths(spark):
    rng, pairs, want = random.Random(8), [], {}
    for k in range(60):
        path = rng.sample(range(10 * k, 10 * k + 8), 8)
        pairs += [(a, b, 1) for a, b in zip(path, path[1:])]
        want |= {a: 10 * k for a in path}
    assert dict(rows(connected_components(spark.createDataFrame(pairs, EDGES)))) == want


def test_spanning_forest_takes_shortest(spark):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (3, 4, 1.0), (2, 3, 9.0), (1, 4, 9.0)]
    found = rows(spanning_forest(spark.createDataFrame(edges, "u long, v long, dist double")))
    assert found == [(0, 1, 1.0), (1, 2, 2.0), (1, 4, 9.0), (3, 4, 1.0)]


def test_degree_counts_lone_nodes(spark):
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 1)], EDGES)
    assert rows(node_degree(edges, spark.range(4))) == [(0, 1), (1, 2), (2, 1), (3, 0)]


def test_location_check():
    relational.check_location(12.97, 77.59, 500)
    with pytest.raises(ValueError):
        relational.check_location(12.9716, 77.5946, 50)


def test_graphml_roundtrip(spark):
    from waymend.sources.graphml import read_graphml, write_graphml

    nodes = spark.createDataFrame([(1, 12.97, 77.59, True), (2, 12.98, 77.6, False)], "id long, y double, x double, is_endpoint boolean")
    edges = spark.createDataFrame([(1, 2, 100.0, 10.0, True)], "u long, v long, weight double, length_px double, healed boolean")
    n, e = read_graphml(spark, write_graphml(nodes, edges))
    assert rows(n) == rows(nodes) and rows(e) == rows(edges)


def test_nodes_without_edges_count(spark):
    """Betweenness, coverage, draws and healing over a network with two lone nodes."""
    edges = spark.createDataFrame([(0, 1, 10), (1, 2, 10)], EDGES)
    nodes = spark.createDataFrame([(k,) for k in range(5)], "id long")
    assert dict(rows(paths.betweenness(edges, nodes))) == {0: 0.0, 1: pytest.approx(2 / (4 * 3)), 2: 0.0, 3: 0.0, 4: 0.0}
    assert tuple(geometry.connectivity_ratio(edges, edges, nodes).first()) == (3, 3, 1.0, 0.6)
    drawn = paths.od_attempts(edges, spark.createDataFrame([(None,)], "closed long"), 200, nodes).collect()
    assert {r.u for r in drawn} | {r.v for r in drawn} == set(range(5))
    assert all(r.connected == (r.u < 3 and r.v < 3) for r in drawn)
    bridges = geometry.heal_bridges(edges, nodes.selectExpr("id", "0.0 AS y", "10.0 * id AS x"), distance=30.0, angle=180.0, nodes=nodes)
    assert rows(bridges.select("u", "v")) == [(0, 2)]
    assert tuple(geometry.heal_summary(geometry.Healing(bridges, bridges, labelled_nodes(edges, nodes))).first()) == (1, 3, 3, 1)


def test_a_whole_network_needs_no_bridge(spark):
    edges = spark.createDataFrame([(0, 1, 10), (1, 2, 10)], EDGES)
    places = spark.createDataFrame([(k, 0.0, 10.0 * k) for k in range(3)], PLACES)
    assert geometry.heal_bridges(edges, places, distance=100.0, angle=180.0).isEmpty()
    assert geometry.heal_bridges(edges.limit(0), places).isEmpty()


def test_accuracy_against_a_truth(spark):
    """Paths that the truth has count against it, others against ten times the straight line."""
    edges = spark.createDataFrame([(0, 1, 110), (1, 2, 100)], EDGES)
    truth = spark.createDataFrame([(0, 1, 100)], EDGES)
    places = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 10.0), (2, 0.0, 20.0)], PLACES)
    error = {(0, 1): 0.1, (1, 2): 0.0, (0, 2): 0.05}
    drawn = [tuple(sorted((r.u, r.v))) for r in paths.od_attempts(edges, spark.createDataFrame([(None,)], "closed long"), 50).collect()]
    r = paths.topological_accuracy(edges, places, truth).first()
    assert r.reachable_pct == 100.0 and r.mean_error_pct == pytest.approx(100 * sum(error[p] for p in drawn) / 50)
    assert tuple(paths.topological_accuracy(edges.limit(0), places).first()) == (0.0, 100.0)


def test_blocks_of_sources_and_closed_searches_by_joins(spark, monkeypatch):
    rng = random.Random(4)
    edges = spark.createDataFrame([(u, v, rng.randint(1, 9)) for u in range(12) for v in range(u + 1, 12) if rng.random() < 0.3], EDGES)
    want = dict(rows(paths.betweenness(edges)))
    sources = spark.createDataFrame([(c, s) for c in (3, 5) for s in (0, 1)], "closed long, src long")
    closed = rows(paths.closed_paths(edges, sources))
    monkeypatch.setattr(paths, "GATHERED_BYTES", 0)
    assert rows(paths.closed_paths(edges, sources)) == closed
    nodes = edges.select("u").union(edges.select("v")).distinct().withColumnRenamed("u", "id")
    n = nodes.count()
    found = {}
    for r in paths.block_dependencies(edges, nodes, n, most=n * n // 2).collect():
        found[r.id] = found.get(r.id, 0) + r.score / ((n - 1) * (n - 2))
    assert {k: pytest.approx(v) for k, v in want.items() if v} == {k: v for k, v in found.items() if v > 1e-12}


def test_network_around_a_place(spark):
    places = spark.createDataFrame([(k, 12.97, 77.59 + 0.001 * k) for k in range(8)], "id long, lat double, lon double")
    ways = spark.createDataFrame([(1, 0, 9.0, "b"), (0, 1, 9.0, "a"), (1, 2, 5.0, "a"), (1, 1, 1.0, "a"), (3, 4, 2.0, "a"), (6, 7, 2.0, "a")], "u long, v long, length double, highway string")
    assert rows(around.network_around(ways, places, 12.97, 77.59, 500.0)) == [(0, 1, 9.0, "a"), (1, 2, 5.0, "a")]
    with pytest.raises(ValueError):
        around.network_around(ways, places, 40.0, 77.59, 500.0)
    with pytest.raises(ValueError):
        relational.node_removal(ways.selectExpr("u", "v", "1L AS w"), places.selectExpr("id AS closed"), most=3)


def test_no_local_checkpoint_folder_on_a_cluster():
    """Only a local master may do without a shared folder."""

    class No:
        def isDefined(self):
            return False

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        return No()

                return Inner

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session)
