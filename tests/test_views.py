"""Networks over the test tables: worked out once, the same as their SQL."""

import duckdb
import pytest

from waymend.plans import catalog, views

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["edges", "broken_edges"])
def test_networks_are_their_sql(spark, name):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{DATA}/lineitem.parquet'")
        want = con.sql(views.SQL[name]).fetchall()
    assert sorted(map(tuple, views.view(spark, DATA, name).collect())) == sorted(want)


def test_pairs_without_order_or_supplier(spark, tmp_path):
    rows = [(1, 1, 10.0), (1, 2, 7.0), (1, 2, 5.0), (1, 3, None), (None, 4, 1.0), (None, 5, 1.0), (2, None, 1.0), (2, 6, 2.0), (2, 6, 3.0), (3, 6, 4.0), (3, 2, 4.0), (4, 7, None), (4, 8, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        for name in views.NETWORKS:
            want = con.sql(views.SQL[name]).fetchall()
            assert sorted(map(str, views.view(spark, str(tmp_path), name).collect())) == sorted(f"Row(u={u}, v={v}, w={w})" for u, v, w in want)


def counted(spark, monkeypatch, query):
    """How often a query works out the suppliers' choices, and the tables that its networks are read from."""
    seen, sql = [], type(spark).sql
    read: list[str] = []

    def counting(self, text, *args, **kwargs):
        seen.append(text == views.CHOICES)
        return sql(self, text, *args, **kwargs)

    def given(spark_, sf_dir, names):
        found = whole(spark_, sf_dir, names)
        read.extend(f for n, df in zip(names, found) if n in views.NETWORKS for f in df.inputFiles())
        return found

    whole = views.views
    monkeypatch.setattr(type(spark), "sql", counting)
    monkeypatch.setattr(catalog, "views", given)
    catalog.QUERIES[query](spark, DATA)
    return sum(seen), read


@pytest.mark.parametrize("query", ["betweenness", "node_closure", "gatekeeper_topn", "top_gatekeeper", "shortest_paths", "topological_accuracy_of_truth", "heal_bridges", "heal_summary", "connectivity_ratio", "heal_bridges_strict", "heal_bridges_narrow"])
def test_networks_are_worked_out_once(spark, monkeypatch, query):
    times, read = counted(spark, monkeypatch, query)
    assert times == 1 and read and not any("lineitem" in f for f in read)


def test_dense_tiles_are_their_sql(spark, tmp_path):
    """Each tile once in full, with lines that lack an order or a part or lie outside; without a join of all pixels."""
    rows = [(1, 5, 0.04, "R"), (1, 5, 0.06, "N"), (1, 69, 0.01, "N"), (1025, 7, None, "R"), (None, 3, 0.02, "R"), (1030, None, 0.03, "N"), (5000, -9, 0.05, "R"), (8, 8, 0.02, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = con.sql(f"WITH {', '.join(f'{n} AS ({views.SQL[n]})' for n in ('scored', 'grid', 'dense'))} SELECT * FROM dense").fetchall()
    got = views.view(spark, str(tmp_path), "dense")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
