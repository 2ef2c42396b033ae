"""A feed of closure events kept up to date per node: an extension, no part of the batch analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure_counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """window, node, closures, severity: events (ts, node, severity) summed by time window; later ones than the lateness allows go."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "node").agg(F.count("*").alias("closures"), F.sum("severity").alias("severity"))
