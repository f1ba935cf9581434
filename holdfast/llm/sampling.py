"""Bounded samples chosen by hash: the same rows on every cluster, never none of many."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(sample: int, rows: int) -> int:
    """The signed 64-bit hashes below this are about `sample` of `rows` values."""
    share = min(Fraction(1), Fraction(sample, max(rows, 1)))
    return int(share * (1 << 64)) - (1 << 63)


def picked(df: DataFrame, sample: int, *by: Column | str, seed: int = 0) -> DataFrame:
    """About `sample` rows of `df`, chosen by the hash of the columns `by`.

    The whole 64-bit hash is compared, so the share can be as small as it needs to be. Rows
    that are equal in all of `by` are in or out together.
    """
    n = df.count()
    if n <= sample:
        return df
    return df.where(F.xxhash64(*by, F.lit(seed)) < F.lit(bound(sample, n)).cast("bigint"))
