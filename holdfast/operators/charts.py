"""The numbers behind charts, as small result tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.hashing import hash_uniform
from holdfast.functions.numbers import nan_to_null
from holdfast.operators.ordered import (
    CHUNK,
    ROWS,
    VALUE,
    quantiles_wide,
    value_chunks,
)
from holdfast.schema import BAND, KEY


def _known(df: DataFrame, column: str) -> DataFrame:
    values = df.select(nan_to_null(F.col(column).cast("double")).alias("x"))
    return values.where(F.col("x").isNotNull())


def _ends(values: DataFrame) -> Column:
    """(low, high) of `x` as one scalar subquery, widened to one unit when equal."""
    ends = values.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    spare = F.when(F.col("low") == F.col("high"), 0.5).otherwise(0.0)
    return ends.select(
        F.struct((F.col("low") - spare).alias("low"), (F.col("high") + spare).alias("high"))
    ).scalar()


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, n): equal bins, closed on the left, the last one on both sides.

    Empty bins are listed. A row belongs to the bin whose printed edges enclose it. Infinite
    values have no place on the axis and are left out, as missing ones are.
    """
    values = _known(df, column).where(F.abs("x") < float("inf"))
    ends = _ends(values)
    low, high = F.col("ends.low"), F.col("ends.high")

    def edge(i: Column) -> Column:
        return low + i * ((high - low) / F.lit(bins))

    nearest = F.least(F.floor((F.col("x") - low) * F.lit(bins) / (high - low)), F.lit(bins - 1))
    near = F.col("near")
    fixed = (
        F.when(F.col("x") < edge(near), near - 1)
        .when((F.col("x") >= edge(near + 1)) & (near < bins - 1), near + 1)
        .otherwise(near)
    )
    counts = (
        values.withColumn("ends", ends)
        .withColumn("near", nearest)
        .groupBy(fixed.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    last = F.col("bin") == bins - 1
    # At most `bins` rows on the right.
    return (
        frame.join(F.broadcast(counts), "bin", "left")
        .withColumn("ends", ends)
        .select(
            "bin",
            edge(F.col("bin")).alias("lo"),
            F.when(last, high).otherwise(edge(F.col("bin") + 1)).alias("hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def density(df: DataFrame, column: str, bins: int = 30, points: int = 200) -> DataFrame:
    """(point, x, y): Gaussian density curve, scaled to lie on a histogram with `bins` bins.

    Bandwidth is the sample deviation times n^(-1/5). Equal values are counted first; the
    `points` kernel sums are one aggregate of fixed width, so no value is copied and a task
    sends one row. Without spread there is no curve.
    """
    values = _known(df, column)
    stats = values.agg(
        F.struct(
            F.min("x").alias("low"),
            F.max("x").alias("high"),
            (F.stddev_samp("x") * F.pow(F.count("x").cast("double"), F.lit(-0.2))).alias("width"),
        )
    ).scalar()
    span = F.col("s.high") - F.col("s.low")
    # The curve's points and each value, in bandwidths from the smallest value.
    step = span / F.lit(points - 1) / F.col("s.width")
    place = (F.col("v") - F.col("s.low")) / F.col("s.width")

    def kernel(point: Column) -> Column:
        away = point * step - place
        return F.exp(away * away * F.lit(-0.5))

    kernels = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), kernel)
    sums = (
        values.groupBy(F.col("x").alias("v"))
        .agg(F.count(F.lit(1)).cast("double").alias(ROWS))
        .withColumn("s", stats)
        .where(F.col("s.width") > 0)
        .select("s", ROWS, array_to_vector(kernels).alias("kernels"))
        .groupBy("s")
        .agg(Summarizer.sum(F.col("kernels"), F.col(ROWS)).alias("sums"))
    )
    scale = span / F.lit(bins) / F.sqrt(F.lit(2.0) * F.pi()) / F.col("s.width")
    # One row with all points becomes a row for each.
    return sums.select("s", F.posexplode(vector_to_array("sums")).alias("point", "y")).select(
        "point",
        (F.col("s.low") + F.col("point") * (span / F.lit(points - 1))).alias("x"),
        (F.col("y") * scale).alias("y"),
    )


def box_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """(grp, q1, median, q3, whisker_lo, whisker_hi, outliers) per group.

    Whiskers end at the outermost values within 1.5 interquartile ranges of the box.
    """
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("grp"), column)
    chunks = value_chunks(rows, column, ["grp"])
    box = quantiles_wide(chunks, {0.25: "q1", 0.5: "median", 0.75: "q3"})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = box.withColumns(
        {"fence_lo": F.col("q1") - reach, "fence_hi": F.col("q3") + reach}
    )
    # Along (grp, chunk), so that a group with most of the rows is many tasks.
    per_chunk = chunks.sizes().select("grp", CHUNK).join(fences, "grp")
    within = F.col(VALUE).between(F.col("fence_lo"), F.col("fence_hi"))
    return (
        chunks.join(per_chunk)
        .groupBy("grp", "q1", "median", "q3")
        .agg(
            F.min(F.when(within, F.col(VALUE))).alias("lo"),
            F.max(F.when(within, F.col(VALUE))).alias("hi"),
            F.sum(F.when(within, 0).otherwise(F.col(ROWS))).alias("outliers"),
        )
        .select(
            "grp",
            "q1",
            "median",
            "q3",
            F.least("lo", "q1").alias("whisker_lo"),
            F.greatest("hi", "q3").alias("whisker_hi"),
            "outliers",
        )
    )


def scatter_grid(
    df: DataFrame, x: str, y: str, x_width: float, y_width: float, hue: str = BAND
) -> DataFrame:
    """(hue, x_lo, y_lo, n): a scatter chart as counts per cell, whatever the number of points."""

    def cell(c: str, width: float):
        return F.floor(nan_to_null(F.col(c).cast("double")) / F.lit(width)) * F.lit(width)

    return (
        df.select(hue, cell(x, x_width).alias("x_lo"), cell(y, y_width).alias("y_lo"))
        .where(F.col("x_lo").isNotNull() & F.col("y_lo").isNotNull())
        .groupBy(hue, "x_lo", "y_lo")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def scatter_points(
    df: DataFrame, x: str, y: str, share: float = 1.0, hue: str = BAND, key: str = KEY
) -> DataFrame:
    """The points of a scatter chart; below 1.0, the share of them that the key hash picks."""
    points = df.select(key, x, y, hue)
    return points if share >= 1.0 else points.where(hash_uniform(key, "points") < share)


def reference_lines(spark: SparkSession, lines: dict[str, DataFrame | float]) -> DataFrame:
    """(line, at): fixed positions and positions read off one-row tables."""
    entries = [
        F.struct(
            F.lit(name).alias("line"),
            (F.lit(v) if isinstance(v, (int, float)) else v.scalar()).cast("double").alias("at"),
        )
        for name, v in lines.items()
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))
