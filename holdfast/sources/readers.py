"""Scans: Parquet tables and subscriber CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.numbers import parse_number
from holdfast.schema import SUBSCRIBER

# The texts pandas reads as missing.
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stands for "nothing between two commas" while a file is read, so that quoted empty text is
# text. No file holds it.
_NOTHING = "\x00nothing\x00"


def _dialect(spark: SparkSession, multi_line: bool):
    """Header line, quotes doubled inside quoted text, nulls apart from empty text."""
    return (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("nullValue", _NOTHING)
        .option("emptyValue", "")
        .option("multiLine", multi_line)
    )


def _by_name(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    """The columns of `schema`, wherever the header has them.

    Every file's header is checked against the first one's. Columns that are not declared
    are left out; a declared one that is missing is an error.
    """
    names = _dialect(spark, multi_line).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in schema.fields}
    found = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    rows = _dialect(spark, multi_line).option("enforceSchema", False).schema(found).csv(path)
    return rows.select(*(f"`{f.name}`" for f in schema.fields))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = SUBSCRIBER,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header line, columns taken by name.

    ``schema=None`` infers the types at the price of a second scan. Line breaks inside
    quotes need `multi_line`, at the price that a file is not split between tasks.
    """
    if schema is None:
        return _dialect(spark, multi_line).option("inferSchema", True).csv(path)
    return _by_name(spark, path, schema, multi_line)


def read_csv_tokens(
    spark: SparkSession,
    path: str,
    schema: T.StructType = SUBSCRIBER,
    tokens: Sequence[str] = MISSING_TOKENS,
    multi_line: bool = True,
) -> DataFrame:
    """CSV whose missing values are spelled as any of `tokens`, in text and number columns alike.

    Line breaks inside quotes are part of the text, as in pandas; files that are known to
    have none are read in splits with ``multi_line=False``.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = _by_name(spark, path, as_text, multi_line)

    def typed(field: T.StructField):
        known = F.when(~F.col(field.name).isin(*tokens), F.col(field.name))
        if not isinstance(field.dataType, T.StringType):
            known = parse_number(known).cast(field.dataType)
        return known.alias(field.name)

    return raw.select(*(typed(f) for f in schema.fields))
