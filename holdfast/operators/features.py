"""Categories to indexes, feature vectors and the train/test split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.hashing import hash_uniform
from holdfast.operators.ordered import in_chunks, running_totals
from holdfast.schema import CATEGORIES, KEY, LEFT, MEASURES, STAYED, TARGET
from holdfast.session import cut_lineage

FEATURES = [*MEASURES, *(f"{c}_index" for c in CATEGORIES)]
SEED = 42


def label_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, labels): distinct values of each column."""
    tall = df.unpivot([], list(columns), "column", "label").distinct()
    return tall.groupBy("column").agg(F.count("label").alias("labels"))


def category_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, label, n, index): labels by falling frequency, ties in alphabetical order.

    All columns are counted in one scan. The rank is a running count over ranges of
    (frequency, label), so no task sees all labels of a column.
    """
    counts = (
        df.unpivot([], list(columns), "column", "label")
        .where(F.col("label").isNotNull())
        .groupBy("column", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("column", F.struct((-F.col("n")).alias("less"), "label").alias("place"))
        .withColumn("one", F.lit(1).cast("bigint"))
    )
    chunks = in_chunks(counts, "place", ["column"], groups=len(columns))
    return running_totals(chunks, "place", ["one"]).select(
        "column",
        "place.label",
        (-F.col("place.less")).alias("n"),
        F.col("one_before").cast("double").alias("index"),
    )


def with_joined_index(
    df: DataFrame, columns: str | Sequence[str], frequent: int = 1000, key: str = KEY
) -> DataFrame:
    """Adds ``<column>_index`` for each column by joins, whatever the number of its labels.

    One dictionary holds the labels of all columns; it is counted in one pass over `df`, written
    once, and none of it passes through the driver but the number of labels per column. The
    `frequent` most frequent labels of a column are broadcast. Only a column that has more
    needs a shuffled join for the others, and as each of these has fewer than one row in
    `frequent`, that join meets no hot label. Rows that need no second look are spread
    by the hash of their key. Null gets the index after the last label.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    labels = cut_lineage(category_labels(df, names))
    sizes = {
        r["column"]: r["n"]
        for r in labels.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    # The caller's columns stay in one struct, so that no helper's name can meet theirs.
    packed = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
        F.xxhash64(key).cast("string").alias("spread"),
    )
    for i, name in enumerate(names):
        packed = _looked_up(
            packed.withColumn("value", F.col("row").getField(name)),
            labels.where(F.col("column") == name).select("label", "index"),
            frequent,
            sizes.get(name, 0),
        ).select("row", "spread", *(f"index{j}" for j in range(i)), F.col("index").alias(f"index{i}"))
    return packed.select(
        "row.*", *(F.col(f"index{i}").alias(f"{name}_index") for i, name in enumerate(names))
    )


def _looked_up(packed: DataFrame, labels: DataFrame, frequent: int, size: int) -> DataFrame:
    """`packed` with the index of its column `value`; `labels` (label, index) has `size` rows."""
    top = labels.where(F.col("index") < frequent).select(
        F.col("label").alias("value"), F.col("index").alias("top_index")
    )
    extra = F.lit(float(size))
    met = packed.join(F.broadcast(top), "value", "left")
    if size <= frequent:
        return met.withColumn("index", F.coalesce("top_index", extra))
    rest = labels.where(F.col("index") >= frequent).select(
        F.lit(True).alias("open"), F.col("label").alias("probe"), F.col("index").alias("rest_index")
    )
    is_open = F.col("top_index").isNull() & F.col("value").isNotNull()
    return (
        met.withColumn("open", is_open)
        .withColumn("probe", F.when(F.col("open"), F.col("value")).otherwise(F.col("spread")))
        .join(rest, ["open", "probe"], "left")
        .withColumn("index", F.coalesce("top_index", "rest_index", extra))
    )


def category_indexer(columns: Sequence[str]) -> Estimator:
    """One indexer for all columns, fitted in one pass; null and unseen share an extra index."""
    return StringIndexer(
        inputCols=list(columns),
        outputCols=[f"{c}_index" for c in columns],
        handleInvalid="keep",
        stringOrderType="frequencyDesc",
    )


def with_category_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``<column>_index`` for each column."""
    return category_indexer(columns).fit(df).transform(df)


def assembler(columns: Sequence[str] = FEATURES, output: str = "features") -> VectorAssembler:
    """Columns into one vector; rows with a missing feature are skipped."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="skip")


def unpacked(df: DataFrame, names: Sequence[str] = FEATURES, vector: str = "features"):
    """The vector's slots as columns of their own, next to the key."""
    slots = vector_to_array(vector)
    return df.select(KEY, *(slots[i].alias(name) for i, name in enumerate(names)))


def frequency_label(indexed: DataFrame, target: str = TARGET) -> DataFrame:
    """label = index of the target as int: 1 means "left" only while leavers are the minority.

    The cast also drops the indexer's extra class, which a binomial model would reject.
    """
    return indexed.withColumn("label", F.col(f"{target}_index").cast("int"))


def outcome_label(df: DataFrame, target: str = TARGET) -> DataFrame:
    """label = 1 for leavers, 0 for stayers, whichever is more frequent; other rows are dropped."""
    return df.where(F.col(target).isin(LEFT, STAYED)).withColumn(
        "label", (F.col(target) == LEFT).cast("int")
    )


def split(
    df: DataFrame, share: float = 0.7, key: str = KEY, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts by key hash: the same rows on every cluster and partitioning."""
    draw = hash_uniform(key, f"split{seed}")
    return df.where(draw < share), df.where(draw >= share)


def random_split(df: DataFrame, share: float = 0.7, seed: int = SEED):
    """Spark's own random split. Which rows land where depends on the partitioning."""
    return tuple(df.randomSplit([share, 1.0 - share], seed=seed))
