"""Independent recomputation of what models and sketches answer, row by row.

A fitted model is a handful of numbers. Here its answers are computed again from those numbers
with plain column expressions, and compared with what the model said.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.numbers import nan_to_null
from holdfast.operators.modelling import model_score
from holdfast.schema import SCORE
from holdfast.session import fresh_dir

SLOTS = "slots"


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Whether two numbers agree, relative to their size where that is above one."""
    size = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.coalesce(F.abs(a - b) <= F.lit(tolerance) * size, F.lit(False))


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def logistic_margin(model: PipelineModel, slots: str = SLOTS) -> Column:
    """coefficients x features + intercept, over an array column of features."""
    fitted = model.stages[-1]
    terms = [F.col(slots)[i] * F.lit(float(c)) for i, c in enumerate(fitted.coefficients)]
    return sum(terms, F.lit(float(fitted.intercept)))


def node_table(
    spark: SparkSession, model: PipelineModel
) -> tuple[DataFrame, dict[int, float]]:
    """Nodes of a fitted forest, one row each, and the weight of every tree.

    Read from the model's own files, whose size depends on trees and depth alone.
    """
    path = fresh_dir(spark, "trees")
    model.stages[-1].save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        "nodeData.id",
        "nodeData.prediction",
        F.col("nodeData.impurityStats").alias("stats"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("goes_left"),
        F.col("nodeData.split.numCategories").alias("categories"),
    )
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight")
    return nodes, {r["tree"]: r["weight"] for r in weights.collect()}


def _walk(nodes: dict[int, Row], at: int, answer: str, slots: str) -> str:
    """One tree as nested conditions, in SQL: left below a threshold or in a set of categories."""
    node = nodes[at]
    if node["left"] < 0:
        return f"{node[answer]!r}D"
    value = f"{slots}[{node['feature']}]"
    if node["categories"] < 0:
        left = f"{value} <= {node['goes_left'][0]!r}D"
    else:
        listed = ", ".join(f"{c!r}D" for c in node["goes_left"])
        left = f"{value} in ({listed})" if listed else "false"
    sides = [_walk(nodes, node[side], answer, slots) for side in ("left", "right")]
    return f"if({left}, {sides[0]}, {sides[1]})"


def tree_walks(
    spark: SparkSession, model: PipelineModel, answer: str, slots: str = SLOTS
) -> list[tuple[float, Column]]:
    """(weight, answer) of every tree, as expressions over an array column of features.

    `answer` is what a leaf gives: its ``prediction``, or the ``share`` of ones in it.
    """
    nodes, weights = node_table(spark, model)
    share = F.try_divide(F.element_at("stats", 2), F.aggregate("stats", F.lit(0.0), lambda s, x: s + x))
    trees: dict[int, dict[int, Row]] = {}
    for row in nodes.withColumn("share", share).collect():
        trees.setdefault(row["tree"], {})[row["id"]] = row
    return [
        (weights[tree], F.expr(_walk(own, 0, answer, slots))) for tree, own in sorted(trees.items())
    ]


def forest_probability(spark: SparkSession, model: PipelineModel) -> Column:
    """The mean over all trees of the share of ones in the leaf that a row ends in."""
    walks = tree_walks(spark, model, "share")
    return sum((c for _, c in walks), F.lit(0.0)) / F.lit(float(len(walks)))


def boosted_probability(spark: SparkSession, model: PipelineModel) -> Column:
    """The logistic function of twice the weighted sum of the trees' answers."""
    walks = tree_walks(spark, model, "prediction")
    return sigmoid(F.lit(2.0) * sum((c * F.lit(w) for w, c in walks), F.lit(0.0)))


def certified(test: DataFrame, model: PipelineModel, again: Column, *keep: str) -> DataFrame:
    """Per row the label, and whether probability and prediction equal those of `again`,
    a probability over the array column `slots`."""
    scored = model_score(test, model).withColumn(SLOTS, vector_to_array("features"))
    told = scored.withColumn("again", again)
    return told.select(
        *keep,
        "label",
        close(F.col(SCORE), F.col("again")).alias("probability_agrees"),
        ((F.col("again") > 0.5).cast("double") == F.col("prediction")).alias("prediction_agrees"),
    )


def log_loss(probability: Column, label: Column) -> Column:
    """The mean log loss, as an aggregate."""
    right = F.when(label == 1, probability).otherwise(1 - probability)
    return F.avg(-F.log(F.greatest(right, F.lit(1e-300))))


def beats_null(learned: DataFrame, model: PipelineModel) -> DataFrame:
    """One row: rows and ones learned from, and whether the model's loss is below that of
    always telling the share of ones."""
    scored = model_score(learned, model)
    ones = F.avg(F.col("label").cast("double"))
    null = -(ones * F.log(ones) + (1 - ones) * F.log(1 - ones))
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label") == 1).alias("n_ones"),
        (log_loss(F.col(SCORE), F.col("label")) < null).alias("beats_null"),
    )


def moments(
    learned: DataFrame, model: PipelineModel, names: list[str], tolerance: float = 1e-4
) -> DataFrame:
    """(feature, observed, agrees): a logistic fit without penalty is at its optimum where the
    sum of each feature over the ones equals its sum weighted by the probabilities."""
    scored = model_score(learned, model).withColumn(SLOTS, vector_to_array("features"))
    sums = []
    for i, name in enumerate(names):
        x = F.col(SLOTS)[i]
        observed = F.sum(F.when(F.col("label") == 1, x).otherwise(0.0).cast("decimal(38,6)"))
        sums.append(
            F.struct(
                F.lit(name).alias("feature"),
                observed.cast("double").alias("observed"),
                F.sum(x * F.col(SCORE)).alias("fitted"),
            )
        )
    wide = scored.agg(F.array(*sums).alias("each"))
    return wide.select(F.inline("each")).select(
        "feature", "observed", close(F.col("observed"), F.col("fitted"), tolerance).alias("agrees")
    )


def median_rank(df: DataFrame, column: str, answer: Column, error: float = 0.001) -> DataFrame:
    """One row: known values, and whether the rank of `answer` among them is within `error` of
    the middle. Equal values share all the ranks that they take."""
    x = nan_to_null(F.col(column).cast("double"))
    n = F.count(x)
    below, upto = F.count_if(x < F.col("answer")), F.count_if(x <= F.col("answer"))
    return df.withColumn("answer", answer).agg(
        n.alias("n_known"),
        ((below <= (0.5 + error) * n) & (upto >= (0.5 - error) * n)).alias("is_median"),
        (F.count_if(x == F.col("answer")) > 0).alias("is_element"),
    )
