"""Writers: result tables, CSV exports and day-partitioned layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "day"


def write_result(df: DataFrame, path: str) -> str:
    """Keep a result table as Parquet, replacing an earlier run."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str, missing: str = "") -> str:
    """CSV with a header; blanks, quotes, line breaks and empty text survive, nulls are
    spelled as `missing`."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("nullValue", missing)
        .option("emptyValue", '""')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def write_day(df: DataFrame, path: str, day: str) -> str:
    """Put one day into a layer. Running the same day again replaces that day alone."""
    (
        df.withColumn(DAY, F.lit(day).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(path)
    )
    return path


def read_day(spark: SparkSession, path: str, day: str) -> DataFrame:
    """One day of a layer; the partition filter keeps other days unread."""
    return spark.read.parquet(path).where(F.col(DAY) == F.lit(day).cast("date")).drop(DAY)
