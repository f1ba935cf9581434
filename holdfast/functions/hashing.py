"""Uniform draws that depend on the row key alone, never on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_sql(key: str, salt: str) -> str:
    """A double in [0, 1) from the first 32 bits of md5(salt:key), as SQL text."""
    return (
        f"(cast(conv(substr(md5(concat('{salt}:', {key})), 1, 8), 16, 10) as double)"
        " / 4294967296D)"
    )


def hash_uniform(key: str, salt: str) -> Column:
    """A double in [0, 1) for the value of column `key`."""
    return F.expr(uniform_sql(f"cast(`{key}` as string)", salt))


def hash_between(key: str, salt: str, low: float, high: float) -> Column:
    """A double in [low, high) for the value of column `key`."""
    draw = uniform_sql(f"cast(`{key}` as string)", salt)
    return F.expr(f"{low}D + {round(high - low, 12)}D * {draw}")
