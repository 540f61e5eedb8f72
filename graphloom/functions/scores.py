"""Arithmetic of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of risk levels, and severities.
HIGH, MEDIUM = 0.67, 0.34
SEVERITY = {"untested": 0.9, "fan_in_10": 0.5, "fan_in_5": 0.3, "packages_3": 0.3, "ambiguous": 0.2, "unresolved": 0.3}


def round_half_up(x: Column, digits: int) -> Column:
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def any_of(severities: list[Column]) -> Column:
    """Probabilistic OR: 1 - product of (1 - s)."""
    rest = F.lit(1.0)
    for s in severities:
        rest = rest * (1 - s)
    return 1 - rest


def risk_level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


#: Fixed value.
BYTES_PER_TOKEN = 4


def tokens(text: Column) -> Column:
    """Estimated model tokens: a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN).cast("long")
