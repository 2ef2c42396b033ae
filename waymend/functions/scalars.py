"""Column functions of the analysis, for use in any query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.geometry import angle_between, norm
from ..operators.relational import valid_location

__all__ = ["angle_between", "haversine_m", "norm", "sigmoid", "valid_location"]

EARTH_RADIUS_M = 6_371_000.0


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Metres between two places on a sphere."""
    half = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(half)))
