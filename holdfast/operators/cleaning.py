"""Cleaning policies for TotalCharges and other columns that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import fill, nan_to_null, parse_number, to_double
from holdfast.operators.ordered import exact_quantiles


def clean_zero(df: DataFrame, column: str = "TotalCharges") -> DataFrame:
    """Bad text becomes missing, missing becomes 0.0: new subscribers have paid nothing yet."""
    return df.withColumn(column, fill(parse_number(F.col(column)), F.lit(0.0)))


def approx_median(df: DataFrame, column: str, relative_error: float = 0.001) -> DataFrame:
    """One row: an element whose rank is within `relative_error` of the middle."""
    known = nan_to_null(F.col(column).cast("double"))
    accuracy = F.lit(round(1 / relative_error))
    return df.agg(F.percentile_approx(known, F.lit(0.5), accuracy).alias("median"))


def middle_element(df: DataFrame, column: str) -> DataFrame:
    """One row: the smallest value with at least half of the rows at or below it."""
    wide = exact_quantiles(df, column, [0.5], interpolate=False)
    return wide.select(F.col("value").alias("median"))


def clean_median(
    df: DataFrame, column: str = "TotalCharges", exact: bool = False
) -> DataFrame:
    """Bad text becomes missing, missing becomes the median of the column.

    The median enters the plan as a scalar subquery; it does not pass through the driver.
    """
    cast = df.withColumn(column, to_double(F.col(column)))
    median = middle_element(cast, column) if exact else approx_median(cast, column)
    return fill_with(cast, column, median.scalar())


def fill_with(df: DataFrame, column: str, value: Column) -> DataFrame:
    """`value` wherever the column is null or NaN."""
    return df.withColumn(column, fill(F.col(column), value))


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only rows that hold a number in each of `columns`; null and NaN both count as missing."""
    return df.na.drop(subset=columns)


def incomplete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows `drop_incomplete` keeps and drops."""
    gap = F.lit(False)
    for c in columns:
        gap = gap | nan_to_null(F.col(c).cast("double")).isNull()
    return df.agg(
        F.count_if(~gap).alias("kept"),
        F.count_if(gap).alias("dropped"),
    )
