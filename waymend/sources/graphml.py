"""GraphML in and out: typed node and edge tables as XML."""

from __future__ import annotations

import uuid
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: The keys of the format, (id, for, name, type).
KEYS = [
    ("d0", "node", "y", "double"),
    ("d1", "node", "x", "double"),
    ("d2", "node", "is_endpoint", "boolean"),
    ("d3", "edge", "weight", "double"),
    ("d4", "edge", "length_px", "double"),
    ("d5", "edge", "healed", "boolean"),
]
_DATA = T.StructField("data", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())])))
NODE = T.StructType([T.StructField("_id", T.StringType()), _DATA])
EDGE = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_target", T.StringType()), _DATA])


def _element(tag: str, attributes: dict[str, str], values: list[tuple[str, str]]) -> Column:
    parts: list[Column] = [F.lit(f"<{tag}")]
    for name, col in attributes.items():
        parts.append(F.concat(F.lit(f' {name}="'), F.col(col).cast("string"), F.lit('"')))
    parts.append(F.lit(">"))
    for key, col in values:
        text = F.col(col).cast("string")
        parts.append(F.coalesce(F.concat(F.lit(f"<data key={quoteattr(key)}>"), text, F.lit("</data>")), F.lit("")))
    parts.append(F.lit(f"</{tag}>"))
    return F.concat(*parts)


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One element a line: the nodes (id, y, x, is_endpoint) and edges (u, v, weight, length_px, healed)."""
    keys = {place: [(k, name) for k, on, name, _ in KEYS if on == place] for place in ("node", "edge")}
    return nodes.select(_element("node", {"id": "id"}, keys["node"]).alias("value")).union(edges.select(_element("edge", {"source": "u", "target": "v"}, keys["edge"]).alias("value")))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> str:
    """Write the graph below path (a folder of its own by default) and give the folder.

    Each part file is a list of elements; the head with the keys and the
    closing tags are files of their own that sort first and last, so the
    concatenated parts are one document.
    """
    spark = nodes.sparkSession
    if path is None:
        cut(spark.range(1))
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/graphml-{uuid.uuid4().hex}"
    head = ['<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'<key id="{k}" for="{on}" attr.name="{name}" attr.type="{kind}"/>' for k, on, name, kind in KEYS), '<graph edgedefault="undirected">']
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/0-head")
    graphml_lines(nodes, edges).write.text(f"{path}/1-body")
    spark.createDataFrame([("</graph></graphml>",)], "value string").coalesce(1).write.text(f"{path}/2-tail")
    return path


def _value(key: str) -> Column:
    return F.filter("data", lambda d: d["_key"] == key)[0]["_VALUE"]


def _id(col: str) -> Column:
    """Ids of digits become numbers; others are hashed, as ids are numbers throughout."""
    return F.when(F.col(col).rlike("^[0-9]+$"), F.col(col).cast("long")).otherwise(F.xxhash64(col))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, y, x, is_endpoint) and edges (u, v, weight, length_px, healed); missing values get 0 or false.

    path: a GraphML file, or a folder from write_graphml, whose body has one element a line.
    """
    if path.endswith((".graphml", ".xml")):
        read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    else:
        lines = spark.read.text(f"{path}/1-body")
        read = lambda tag, schema: lines.where(F.col("value").startswith(f"<{tag} ")).select(F.from_xml("value", schema).alias("e")).select("e.*")
    nodes, edges = read("node", NODE), read("edge", EDGE)

    def typed(place: str) -> list[Column]:
        return [F.coalesce(_value(k).cast(kind), F.lit(False) if kind == "boolean" else F.lit(0.0)).alias(name) for k, on, name, kind in KEYS if on == place]

    return nodes.select(_id("_id").alias("id"), *typed("node")), edges.select(_id("_source").alias("u"), _id("_target").alias("v"), *typed("edge"))
