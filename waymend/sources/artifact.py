"""The healed network as JSON lines, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def artifact_lines(nodes: DataFrame, edges: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """value: one JSON object a line, of kind metadata, node or edge, so that the artifact is written and read in parallel."""
    head = nodes.sparkSession.createDataFrame([(metadata,)], "metadata map<string,string>")
    row = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value"))
    finite = [F.when(F.abs(F.col(c)) != float("inf"), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in edges.dtypes]
    return row(head, "metadata").union(row(nodes, "node")).union(row(edges.select(*finite), "edge"))


def write_artifact(nodes: DataFrame, edges: DataFrame, metadata: dict[str, str], path: str) -> None:
    artifact_lines(nodes, edges, metadata).write.text(path)


def deliverable(closures: DataFrame) -> DataFrame:
    """The report of closures, rounded as it is shown: index to 4 places, impact to 2, length to 3."""
    return closures.select(
        "closed_node_id", F.bround("resilience_index", 4).alias("resilience_index"), F.bround("travel_time_impact_pct", 2).alias("travel_time_impact_pct"),
        F.bround("affected_segment_length_km", 3).alias("affected_km"), "disconnected", "disconnected_pair_count",
    )
