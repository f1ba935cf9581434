"""Profiles of a table: shape, schema, missing values, descriptive statistics, preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.numbers import nan_to_null, round_even
from holdfast.operators.ordered import (
    CHUNK,
    ROWS,
    VALUE,
    quantiles_wide,
    value_chunks,
)
from holdfast.schema import numeric_columns

QUARTILES = {0.25: "q25", 0.5: "q50", 0.75: "q75"}


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")
    )


def _is_missing(field: T.StructField) -> Column:
    c = F.col(field.name)
    floating = isinstance(field.dataType, (T.DoubleType, T.FloatType))
    return (nan_to_null(c) if floating else c).isNull()


def missing_wide(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: missing values per column, counted in one pass."""
    return df.agg(
        *(
            F.count_if(_is_missing(f)).alias(f.name)
            for f in df.schema.fields
            if columns is None or f.name in columns
        )
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing) for every column."""
    return missing_wide(df).unpivot([], list(df.columns), "column", "missing")


def schema_listing(df: DataFrame) -> DataFrame:
    """(ordinal, name, type, known) for every column, with the number of known values."""
    facts = F.create_map(
        *(
            part
            for i, f in enumerate(df.schema.fields)
            for part in (
                F.lit(f.name),
                F.struct(
                    F.lit(i).alias("ordinal"), F.lit(f.dataType.simpleString()).alias("type")
                ),
            )
        )
    )
    known = df.agg(*(F.count_if(~_is_missing(f)).alias(f.name) for f in df.schema.fields))
    return (
        known.unpivot([], list(df.columns), "name", "known")
        .withColumn("fact", facts[F.col("name")])
        .select("fact.ordinal", "name", "fact.type", "known")
    )


def text_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, unique, top, freq); the smallest of equally frequent values is on top.

    Values are counted by a digest of 128 bits, so that no text is shuffled to be counted (texts
    with equal digests would count as one). Only the texts of each column's most frequent
    digests are looked up, in a second pass over `df`; where nothing repeats, the top is
    the column's smallest text.
    """
    tall = df.unpivot([], list(columns), "column", "text")
    digest = F.struct(F.xxhash64("text"), F.xxhash64(F.lit("second half"), "text"))
    marked = tall.withColumn("digest", F.when(F.col("text").isNotNull(), digest))
    counts = marked.groupBy("column", "digest").agg(F.count("text").alias(ROWS))
    facts = counts.groupBy("column").agg(
        F.sum(ROWS).alias("count"),
        F.count("digest").alias("unique"),
        F.nullif(F.max(ROWS), F.lit(0)).alias("freq"),
    )
    repeated = facts.where("freq > 1").select("column", F.col("freq").alias(ROWS))
    leading = counts.join(F.broadcast(repeated), ["column", ROWS]).select("column", "digest")
    # Few digests are broadcast by their measured size; many are all equally rare.
    # Their texts are made distinct by hash first: a smallest text per group needs a sort.
    tops = marked.join(leading, ["column", "digest"], "left_semi").select("column", "text")
    tops = tops.distinct().groupBy("column").agg(F.min("text").alias("top"))
    least = df.agg(*(F.min(c).alias(c) for c in columns))
    least = least.unpivot([], list(columns), "column", "least")
    # One row per column on both sides.
    return (
        facts.join(F.broadcast(least), "column")
        .join(F.broadcast(tops), "column", "left")
        .select("column", "count", "unique", F.coalesce("top", "least").alias("top"), "freq")
    )


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) with interpolated quartiles.

    The table is read once, for all columns together; the rest works on distinct values.
    """
    wanted = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    stacked = wanted.unpivot([], list(columns), "column", "number")
    names = df.sparkSession.range(1).select(
        F.explode(F.array(*(F.lit(c) for c in columns))).alias("column")
    )
    chunks = value_chunks(stacked, "number", ["column"], groups=len(columns))
    quartiles = quantiles_wide(chunks, QUARTILES)
    means = chunks.rows.groupBy("column").agg(
        (F.sum(F.col(VALUE) * F.col(ROWS)) / F.sum(ROWS)).alias("mean")
    )
    # The mean travels along (column, chunk), so that one long column is many tasks.
    per_chunk = chunks.sizes().select("column", CHUNK).join(means, "column")
    squares = F.sum(F.col(ROWS) * F.pow(F.col(VALUE) - F.col("mean"), F.lit(2.0)))
    moments = (
        chunks.join(per_chunk)
        .groupBy("column")
        .agg(
            F.sum(ROWS).alias("count"),
            F.max("mean").alias("mean"),
            F.sqrt(F.try_divide(squares, F.sum(ROWS) - 1)).alias("std"),
            F.min(VALUE).alias("min"),
            F.max(VALUE).alias("max"),
        )
    )
    known = moments.join(quartiles, "column")
    return names.join(known, "column", "left").select(
        "column",
        F.coalesce("count", F.lit(0)).alias("count"),
        "mean",
        "std",
        "min",
        *QUARTILES.values(),
        "max",
    )


def describe_all(df: DataFrame, digits: int | None = None) -> DataFrame:
    """One row per column: text statistics for text columns, numeric ones for the others."""
    numeric = numeric_columns(df.schema)
    text = [c for c in df.columns if c not in numeric]
    as_text = df.select(*(F.col(c).cast("string").alias(c) for c in text))
    parts = []
    if text:
        parts.append(text_profile(as_text, text))
    if numeric:
        parts.append(numeric_profile(df, numeric))
    profile = parts[0]
    for part in parts[1:]:
        profile = profile.unionByName(part, allowMissingColumns=True)
    return _rounded(profile, digits)


def describe_numeric(df: DataFrame, column: str, digits: int | None = 2) -> DataFrame:
    """Profile of one numeric column, rounded half to even."""
    return _rounded(numeric_profile(df, [column]), digits)


def _rounded(profile: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return profile
    doubles = [f.name for f in profile.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return profile.withColumns({c: round_even(F.col(c), digits) for c in doubles})


def first_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first `n` rows by key."""
    return df.orderBy(key).limit(n)


def head_transposed(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first `n` rows by key, as one row per column and one text value per row."""
    # The window sees the n rows of the preview only.
    numbered = first_rows(df, key, n).select(
        F.row_number().over(Window.orderBy(key)).alias("row"),
        *(F.col(c).cast("string").alias(f"{c}") for c in df.columns),
    )
    tall = numbered.unpivot(["row"], list(df.columns), "column", "text")
    return tall.groupBy("column").agg(
        *(F.max(F.when(F.col("row") == i, F.col("text"))).alias(f"row{i}") for i in range(1, n + 1))
    )
