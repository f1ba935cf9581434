"""Summaries by risk band and by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.numbers import money_sum, money_text, round_even
from holdfast.operators.ordered import exact_quantiles
from holdfast.schema import BAND, BANDS, HIGH, KEY, LEFT, MEDIUM, TARGET


def band_table(spark: SparkSession, bands: list[str] = BANDS) -> DataFrame:
    """(position, band) in report order."""
    entries = F.array(*(F.lit(b) for b in bands))
    return spark.range(1).select(F.posexplode(entries).alias("position", BAND))


def in_band_order(summary: DataFrame, bands: list[str] = BANDS) -> DataFrame:
    """One row per band in report order; an absent band keeps missing values."""
    # One row per band is left to broadcast, whatever else the column holds.
    known = summary.where(F.col(BAND).isin(*bands))
    return (
        band_table(summary.sparkSession, bands)
        .join(F.broadcast(known), BAND, "left")
        .orderBy("position")
        .drop("position")
    )


def band_summary(banded: DataFrame, digits: int | None = 1) -> DataFrame:
    """Customers, recurring revenue and mean tenure per band."""
    tenure = F.avg("tenure")
    grouped = banded.groupBy(BAND).agg(
        F.count(KEY).alias("Total_Clientes"),
        money_sum(F.col("MonthlyCharges")).alias("MRR_Total"),
        (tenure if digits is None else round_even(tenure, digits)).alias("Tenure_Promedio"),
    )
    return in_band_order(grouped).withColumn("MRR_Total_USD", money_text(F.col("MRR_Total")))


def revenue_at_risk(banded: DataFrame) -> DataFrame:
    """One row: revenue of the high band, of the medium band, and of both, in one pass."""

    def revenue(band: str):
        hit = F.when(F.col(BAND) == band, F.col("MonthlyCharges"))
        return F.coalesce(money_sum(hit), F.lit(0.0))

    both = F.when(F.col(BAND).isin(HIGH, MEDIUM), F.col("MonthlyCharges"))
    total = F.coalesce(money_sum(both), F.lit(0.0))
    return banded.agg(
        revenue(HIGH).alias("mrr_high"),
        revenue(MEDIUM).alias("mrr_medium"),
        total.alias("mrr_at_risk"),
        money_text(total).alias("mrr_at_risk_usd"),
    )


def band_counts(banded: DataFrame) -> DataFrame:
    """Subscribers per band in report order."""
    return in_band_order(banded.groupBy(BAND).agg(F.count(F.lit(1)).alias("n")))


def band_bars(summary: DataFrame, value: str = "MRR_Total") -> DataFrame:
    """Bar height per band: the mean of the summary rows of that band."""
    return in_band_order(summary.groupBy(BAND).agg(F.avg(value).alias(value)))


def counts_by(df: DataFrame, category: str, outcome: str = TARGET) -> DataFrame:
    """Rows per category and outcome; rows missing either are left out."""
    return (
        df.where(F.col(category).isNotNull() & F.col(outcome).isNotNull())
        .groupBy(category, outcome)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def leaving_rate(df: DataFrame, category: str | None = None) -> DataFrame:
    """Customers, leavers and share of leavers, overall or per category."""
    left = F.count_if(F.col(TARGET) == LEFT)
    known = df.where(F.col(TARGET).isNotNull())
    if category is not None:
        known = known.where(F.col(category).isNotNull())
    return known.groupBy(*([category] if category else [])).agg(
        F.count(F.lit(1)).alias("customers"),
        left.alias("leavers"),
        F.try_divide(left, F.count(F.lit(1))).alias("leaving_rate"),
    )


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row: the interpolated median; no task holds the whole column."""
    found = exact_quantiles(df, column, [0.5]).select(F.col("value").alias("median"))
    # A column without values has no quantile, but still one row.
    return found.agg(F.max("median").alias("median"))
