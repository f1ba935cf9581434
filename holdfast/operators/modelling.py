"""Training, scoring and evaluating binary risk models."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import nan_to_null, to_double
from holdfast.operators.features import (
    FEATURES,
    SEED,
    assembler,
    category_indexer,
    outcome_label,
    split,
)
from holdfast.operators.ordered import Chunks, in_chunks, running_totals
from holdfast.schema import CATEGORIES, SCORE
from holdfast.session import cut_lineage

FILLED = "TotalCharges_filled"


def logistic(iterations: int = 10) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol="label", maxIter=iterations, family="binomial"
    )


def forest(trees: int = 20) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=trees, seed=SEED
    )


def boosted(rounds: int = 10) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, seed=SEED)


def scorable(df: DataFrame) -> DataFrame:
    """Subscriber rows that a fitted model can score: a numeric TotalCharges, no row dropped."""
    return df.withColumn("TotalCharges", to_double(F.col("TotalCharges")))


def prepared(df: DataFrame) -> DataFrame:
    """Rows to learn from: scorable, with a known outcome as a 0/1 label."""
    return outcome_label(scorable(df))


def sized(classifier: Estimator, preparation: PipelineModel) -> Estimator:
    """Trees need a bin per category: the classifier with as many as the indexers found."""
    if not classifier.hasParam("maxBins"):
        return classifier
    labels = [
        len(found) + 1
        for stage in preparation.stages
        if isinstance(stage, StringIndexerModel)
        for found in stage.labelsArray
    ]
    bins = max([classifier.getOrDefault("maxBins"), *labels])
    return classifier.copy({classifier.getParam("maxBins"): bins})


def stages(classifier: Estimator | None = None) -> Pipeline:
    """Median fill, category indexes, feature vector and, if given, a classifier."""
    steps: list[Estimator] = [
        Imputer(
            strategy="median",
            relativeError=0.001,
            inputCols=["TotalCharges"],
            outputCols=[FILLED],
        ),
        category_indexer(CATEGORIES),
        assembler([FILLED if c == "TotalCharges" else c for c in FEATURES]),
    ]
    return Pipeline(stages=steps + ([classifier] if classifier is not None else []))


def train(
    df: DataFrame, classifier: Estimator | None = None, fit_on: str = "all", share: float = 0.7
) -> tuple[PipelineModel, DataFrame]:
    """(model, test rows). With ``fit_on="all"`` median and indexes have seen the test rows too;
    ``"train"`` keeps them to the training rows. The classifier sees training rows only.

    Every fitting step reads the rows again, so they are written once and read from there.
    """
    rows = cut_lineage(prepared(df))
    classifier = logistic() if classifier is None else classifier
    learn, test = split(rows, share)
    preparation = stages().fit(learn if fit_on == "train" else rows)
    fitted = sized(classifier, preparation).fit(preparation.transform(learn))
    return PipelineModel(stages=[*preparation.stages, fitted]), test


def model_score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds the probability of leaving, under the same name as the rule score."""
    scored = model.transform(df)
    return scored.withColumn(SCORE, vector_to_array("probability")[1])


def predictions(scored: DataFrame, *keep: str) -> DataFrame:
    """label, margin, probability and 0/1 prediction as plain columns."""
    return scored.select(
        *keep,
        "label",
        vector_to_array("rawPrediction")[1].alias("margin"),
        vector_to_array("probability")[1].alias("probability"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def evaluator_auc(scored: DataFrame, raw: str = "rawPrediction", label: str = "label") -> DataFrame:
    """One row: Spark's area under the ROC curve, from every distinct score."""
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol=raw, labelCol=label, metricName="areaUnderROC", numBins=0
    )
    return scored.sparkSession.range(1).select(F.lit(evaluator.evaluate(scored)).alias("auc"))


def score_chunks(df: DataFrame, score: str, label: str) -> Chunks:
    """Positives and negatives per distinct score, chunked in score order."""
    counts = (
        df.select(nan_to_null(F.col(score)).alias("score"), label)
        .where(F.col("score").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("score")
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )
    return in_chunks(counts, "score")


def exact_auc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row: the share of (leaver, stayer) pairs the score ranks right, ties counting half.

    Null where there are no leavers or no stayers.
    """
    ranked = running_totals(score_chunks(df, score, label), "score", ["neg"])
    below = F.col("neg_before") + F.col("neg") / 2.0
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.try_divide(F.sum(F.col("pos") * below), pairs).alias("auc"))


def recall_threshold(
    df: DataFrame, score: str, label: str = "label", recall: float = 0.8
) -> DataFrame:
    """One row: the highest threshold that still finds `recall` of the leavers, with its counts.

    A subscriber is predicted to leave when the score is at or above the threshold.
    """
    chunks = score_chunks(df, score, label)
    totals = chunks.rows.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).scalar()
    at = (
        running_totals(chunks, "score", ["pos", "neg"])
        .withColumn("all", totals)
        .select(
            F.col("score").alias("threshold"),
            (F.col("all.pos") - F.col("pos_before")).alias("tp"),
            (F.col("all.neg") - F.col("neg_before")).alias("fp"),
            F.col("pos_before").alias("fn"),
            F.col("neg_before").alias("tn"),
            F.try_divide(F.col("all.pos") - F.col("pos_before"), F.col("all.pos")).alias("recall"),
        )
        .where(F.col("recall") >= recall)
    )
    best = at.agg(F.max_by(F.struct(*at.columns), "threshold").alias("best")).select("best.*")
    return best.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp")))
