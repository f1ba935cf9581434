"""Scores by business rule, and what every score leads to: flag and band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.hashing import hash_between
from holdfast.functions.risk import both_equal, clip, flag, risk_band
from holdfast.schema import BAND, FLAG, KEY, SCORE


def critical_profile() -> Column:
    """Fiber customers without a long contract."""
    return both_equal(
        F.col("InternetService"), "Fiber optic", F.col("Contract"), "Month-to-month"
    )


def rule_score(df: DataFrame, key: str = KEY) -> DataFrame:
    """Base risk in [0.1, 0.4) per subscriber, raised by [0.3, 0.5) for the critical profile."""
    base = hash_between(key, "base", 0.1, 0.4)
    rise = F.when(critical_profile(), hash_between(key, "bump", 0.3, 0.5)).otherwise(0.0)
    return df.withColumn(SCORE, base + rise).withColumn(SCORE, clip(F.col(SCORE)))


def with_risk(scored: DataFrame, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """Flag and band next to a score, whoever computed it."""
    return scored.withColumns(
        {FLAG: flag(F.col(SCORE), threshold, strict), BAND: risk_band(F.col(SCORE))}
    )
