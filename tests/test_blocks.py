"""Blocks and betweenness by blocks against removal of each node and searches over the whole network."""

import random
from collections import defaultdict

import pytest

from waymend.operators import blocks, paths


@pytest.fixture(scope="module")
def network():
    """Cycles that share nodes, bridges, a star, a dense part, an own component, parallel edges, a loop."""
    rng = random.Random(3)
    edges = [(k, (k + 1) % 7, rng.randrange(1, 4)) for k in range(7)] + [(3, 10, 2), (10, 11, 1), (11, 12, 1), (12, 10, 1), (11, 13, 5), (13, 14, 1), (14, 11, 2)]
    edges += [(14, 20 + k, 1) for k in range(5)] + [(20, 30, 2), (30, 31, 1)] + [(40 + a, 40 + b, 1) for a in range(5) for b in range(a)] + [(31, 40, 1), (100, 101, 1), (101, 102, 1), (102, 100, 1), (102, 103, 9)]
    edges += [(50 + k, 51 + k, 1) for k in range(9)] + [(50, 59, 3), (52, 57, 1), (55, 44, 2), (50, 0, 4)]
    return edges + [(3, 10, 7), (4, 4, 1)]


@pytest.fixture(scope="module")
def parted(spark, network):
    """The blocks and the forest, worked out once."""
    return blocks.blocks(spark.createDataFrame(network, "u long, v long, w long").repartition(3))


def pieces(edges, gone=None):
    near = defaultdict(set)
    for u, v, _ in edges:
        if gone not in (u, v):
            near[u].add(v)
            near[v].add(u)
    label = {}
    for s in near:
        if s not in label:
            todo, label[s] = [s], s
            while todo:
                for q in near[todo.pop()]:
                    if q not in label:
                        label[q] = s
                        todo.append(q)
    return label, near


def test_articulation_points(parted, network, monkeypatch):
    _, near = pieces(network)
    want = {}
    for x in near:
        label, _ = pieces(network, x)
        parts = {label.get(q, q) for q in near[x] if q != x}
        if len(parts) > 1:
            want[x] = len(parts)
    monkeypatch.setattr(blocks, "blocks", lambda edges: parted)
    assert {r.id: r.n_blocks for r in blocks.articulation_points(None).collect()} == want


def test_blocks_hold_edges_of_common_cycles(parted, network):
    """Two edges are of one block if they are the same edge or no node parts them: unions of edge pairs at a node that its removal leaves connected."""
    of, _ = parted
    simple = sorted({(min(u, v), max(u, v)) for u, v, _ in network if u != v})
    parent = {e: e for e in simple}

    def root(e):
        while parent[e] != e:
            e = parent[e]
        return e

    _, near = pieces(network)
    for x in near:
        label, _ = pieces(network, x)
        for a in near[x]:
            for b in near[x]:
                if x not in (a, b) and label.get(a, a) == label.get(b, b):
                    parent[root((min(x, a), max(x, a)))] = root((min(x, b), max(x, b)))
    groups, got = defaultdict(set), defaultdict(set)
    for e in simple:
        groups[root(e)].add(e)
    for r in of.collect():
        got[r.block].add((r.u, r.v))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("block_edges,task_work", [(100_000, 20), (8, 20_000_000)])
def test_betweenness_by_blocks(spark, parted, network, monkeypatch, block_edges, task_work):
    monkeypatch.setattr(blocks, "blocks", lambda edges: parted)
    df = spark.createDataFrame(network, "u long, v long, w long")
    nodes = spark.createDataFrame([(900,)], "id long")
    simple = df.where("u <> v").groupBy("u", "v").min("w").withColumnRenamed("min(w)", "w")
    want = {r.id: r.score for r in paths.betweenness(simple, nodes).collect()}
    got = {r.id: r.score for r in blocks.block_betweenness(df, nodes, block_edges=block_edges, task_work=task_work).collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
