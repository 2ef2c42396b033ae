"""Graph and raster stand-ins derived from whole plain tables, the same definition for both engines.

The network links each supplier with the two that it shares most orders with;
the broken one keeps only a supplier's first choice, and only where it is
among the other's first three. A line of an order is a pixel; tiles hold a
range of orders, so their number grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

SIDE = 64
#: Orders of a sparse tile (masks) and of a dense one (images, scores).
SPARSE, DENSE = 128, 1024

PARTNERS = (
    "WITH pairs AS (SELECT a.l_suppkey AS u, b.l_suppkey AS v, count(*) AS n, CAST(round(100 * min(least(a.l_extendedprice, b.l_extendedprice))) AS BIGINT) AS w "
    "FROM {t} a JOIN {t} b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2), "
    "ranked AS (SELECT u, v, w, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS r FROM pairs) "
)
EDGES = PARTNERS + "SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v, w FROM ranked WHERE r <= 2"
BROKEN = PARTNERS + "SELECT DISTINCT least(a.u, a.v) AS u, greatest(a.u, a.v) AS v, a.w AS w FROM ranked a JOIN ranked b ON a.u = b.v AND a.v = b.u WHERE a.r = 1 AND b.r <= 3"

#: What Spark runs instead of PARTNERS, with the same rows: a pair of suppliers is summed once and then stands both ways, and only first to third choices stay.
CHOICES = (
    "WITH pairs AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n, CAST(round(100 * min(least(a.l_extendedprice, b.l_extendedprice))) AS BIGINT) AS w "
    "FROM {t} a JOIN {t} b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2), "
    "sides AS (SELECT stack(2, a, b, b, a) AS (u, v), n, w FROM pairs), "
    "ranked AS (SELECT u, v, w, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS r FROM sides) "
    "SELECT u, v, w, r FROM ranked WHERE r <= 3"
)
#: The networks over them.
NETWORKS = {name: "WITH ranked AS (SELECT * FROM {t}) " + sql.removeprefix(PARTNERS) for name, sql in (("edges", EDGES), ("broken_edges", BROKEN))}


def tile(orders: int) -> str:
    return f"CAST(floor(l_orderkey / {orders}) AS INT)"


def pixels(y: str) -> str:
    return f"SELECT DISTINCT {tile(SPARSE)} AS tile_id, CAST({y} AS INT) AS y, CAST(l_orderkey % {SIDE} AS INT) AS x FROM {{t}}"


AT = f"{tile(DENSE)} AS tile_id, CAST(l_partkey % {SIDE} AS INT) AS y, CAST(l_orderkey % {SIDE} AS INT) AS x"
SCORED = f"SELECT {AT}, 0.05 + 9 * max(l_discount) AS p, max(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS t FROM {{t}} GROUP BY 1, 2, 3"
FROM_LINES = {
    "edges": EDGES,
    "broken_edges": BROKEN,
    "mask": pixels(f"l_partkey % {SIDE}"),
    "pred": pixels(f"(l_partkey + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) % {SIDE}"),
    "occ": pixels(f"l_suppkey % {SIDE}"),
    "scored": SCORED,
}

#: DuckDB definitions, used in WITH clauses in this order.
SQL = {n: sql.format(t="lineitem") for n, sql in FROM_LINES.items()} | {
    "all_nodes": "SELECT s_suppkey AS id FROM supplier",
    "gpos": "SELECT vec_id AS id, 100 * CAST(embedding[1] AS DOUBLE) AS y, 100 * CAST(embedding[2] AS DOUBLE) AS x FROM embeddings",
    "multi_edges": "SELECT l_suppkey AS u, l_partkey % 100 AS v, l_extendedprice AS length, l_returnflag AS highway FROM lineitem",
    "grid": f"SELECT tile_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT tile_id FROM scored), range({SIDE}) b(y), range({SIDE}) c(x)",
    "dense": "SELECT g.tile_id, g.y, g.x, coalesce(p, 0.05::DOUBLE) AS p, coalesce(t, 0::DOUBLE) AS t FROM grid g LEFT JOIN scored USING (tile_id, y, x)",
}


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> list[DataFrame]:
    """The views named. Suppliers' choices are worked out once for all networks among them, and written: what follows reads a few rows a supplier, however often."""
    choices = None
    if any(n in NETWORKS for n in names):
        choices = cut(spark.sql(CHOICES, t=spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
    return [cut(spark.sql(NETWORKS[n], t=choices)) if n in NETWORKS else view(spark, sf_dir, n) for n in names]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name in NETWORKS:
        return views(spark, sf_dir, (name,))[0]
    if name in FROM_LINES:
        return spark.sql(FROM_LINES[name], t=read("lineitem"))
    if name == "all_nodes":
        return read("supplier").select(F.col("s_suppkey").alias("id"))
    if name == "gpos":
        return read("embeddings").select(F.col("vec_id").alias("id"), *((100 * F.element_at("embedding", k).cast("double")).alias(c) for k, c in ((1, "y"), (2, "x"))))
    if name == "multi_edges":
        return read("lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") % 100).alias("v"), F.col("l_extendedprice").alias("length"), F.col("l_returnflag").alias("highway"))
    if name == "dense":
        # A tile's scored places are put together once, and what they leave is added; so no table of all pixels is joined.
        on_tile = F.col("tile_id").isNotNull() & F.col("y").between(0, SIDE - 1) & F.col("x").between(0, SIDE - 1)
        cell = F.when(on_tile, F.struct((F.col("y") * SIDE + F.col("x")).alias("at"), F.coalesce("p", F.lit(0.05)).alias("p"), F.coalesce("t", F.lit(0.0)).alias("t")))
        tiles = view(spark, sf_dir, "scored").groupBy("tile_id").agg(F.collect_list(cell).alias("given"))
        rest = F.array_except(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), F.col("given.at"))
        rest = F.transform(rest, lambda at: F.struct(at.alias("at"), F.lit(0.05).alias("p"), F.lit(0.0).alias("t")))
        cells = tiles.select("tile_id", F.explode(F.concat("given", rest)).alias("c"))
        return cells.select("tile_id", F.floor(F.col("c.at") / SIDE).cast("int").alias("y"), (F.col("c.at") % SIDE).alias("x"), "c.p", "c.t")
    raise KeyError(name)


def with_views(names: str, more: list[tuple[str, str]], final: str) -> str:
    """A DuckDB statement over the named views and further steps."""
    wanted = names.split()
    if "dense" in wanted:
        wanted += ["grid", "scored"]
    steps = [(n, SQL[n]) for n in SQL if n in wanted] + more
    return "WITH RECURSIVE " + ",\n".join(f"{n} ({sql})" if n.endswith("AS") else f"{n} AS ({sql})" for n, sql in steps) + "\n" + final
