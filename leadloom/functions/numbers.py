"""Rounding and clamping, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def ratio(part: Column, total: Column, digits: int = 3) -> Column:
    """part / total, rounded half up with integers alone; 0 for an empty total."""
    scale = 10**digits
    return F.when(total == 0, F.lit(0.0)).otherwise(F.floor((part * (2 * scale) + total) / (total * 2)).cast("double") / scale)
