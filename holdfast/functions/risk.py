"""Score, flag and band expressions. All of them treat NaN as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.functions.numbers import nan_to_null
from holdfast.schema import HIGH, HIGH_ABOVE, LOW, MEDIUM, MEDIUM_FROM


def both_equal(a: Column, a_value: str, b: Column, b_value: str) -> Column:
    """Conjunction of two equalities as a mask without nulls."""
    return F.coalesce((a == a_value) & (b == b_value), F.lit(False))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Into [low, high]; missing stays missing (greatest and least skip nulls)."""
    known = nan_to_null(c)
    return F.when(known.isNotNull(), F.least(F.greatest(known, F.lit(low)), F.lit(high)))


def flag(c: Column, threshold: float = MEDIUM_FROM, strict: bool = False) -> Column:
    """1 at or above the threshold (above it when strict), else 0, also when missing."""
    known = nan_to_null(c)
    hit = known > threshold if strict else known >= threshold
    return F.when(hit, 1).otherwise(0)


def risk_band(c: Column) -> Column:
    """High above 0.70, medium from 0.50 to 0.70, low for the rest and for missing."""
    known = nan_to_null(c)
    return (
        F.when(known > HIGH_ABOVE, HIGH)
        .when(known.between(MEDIUM_FROM, HIGH_ABOVE), MEDIUM)
        .otherwise(LOW)
    )
