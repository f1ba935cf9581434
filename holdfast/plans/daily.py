"""The daily run: raw, clean, feature and scored layers, one partition per day, and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession

from holdfast.operators import modelling
from holdfast.operators.cleaning import clean_median, clean_zero
from holdfast.operators.features import (
    FEATURES,
    assembler,
    category_indexer,
    outcome_label,
)
from holdfast.operators.scoring import rule_score, with_risk
from holdfast.schema import CATEGORIES, KEY
from holdfast.session import cut_lineage
from holdfast.sources.models import load_model, save_model
from holdfast.sources.sinks import read_day, write_day

LAYERS = ("raw", "clean", "scored")
MODEL_LAYERS = ("raw", "clean", "features", "scored")


def run_day(
    spark: SparkSession,
    arrivals: DataFrame,
    root: str,
    day: str,
    score: Callable[[DataFrame], DataFrame] = rule_score,
) -> dict[str, str]:
    """Write the three layers of one day; a second run of the day replaces its partitions.

    Each layer is read back from the one before, so nothing upstream is computed twice.
    """
    paths = {layer: f"{root}/{layer}" for layer in LAYERS}
    write_day(arrivals, paths["raw"], day)
    write_day(clean_zero(read_day(spark, paths["raw"], day)), paths["clean"], day)
    write_day(
        with_risk(score(read_day(spark, paths["clean"], day))), paths["scored"], day
    )
    return paths


def fit_day(
    spark: SparkSession, root: str, day: str, classifier: Estimator | None = None
) -> PipelineModel:
    """Fit category indexes, feature vector and classifier on a day's clean layer, and keep them.

    Only rows with a known outcome teach the classifier. The model is stored whole, so a
    later run scores with the indexes of the day that it was fitted on.
    """
    rows = cut_lineage(outcome_label(read_day(spark, f"{root}/clean", day)))
    preparation = Pipeline(stages=[category_indexer(CATEGORIES), assembler()]).fit(rows)
    classifier = modelling.logistic() if classifier is None else classifier
    fitted = modelling.sized(classifier, preparation).fit(preparation.transform(rows))
    model = PipelineModel(stages=[*preparation.stages, fitted])
    save_model(model, f"{root}/models", day)
    return model


def run_model_day(
    spark: SparkSession,
    arrivals: DataFrame,
    root: str,
    day: str,
    classifier: Estimator | None = None,
) -> dict[str, str]:
    """Write the four layers of one day and fit its model, for the days to come.

    raw: as it came. clean: missing totals become the day's median. features: the vector's slots
    as columns, by the indexes of the newest model of an earlier day; rows that lack a feature
    have none. scored: all columns of clean with that model's probability, flag and band.
    The first day of a root has no earlier model; its own is used, which is fitted before.
    A second run of a day replaces its partitions and its model, and uses the same earlier one.
    """
    paths = {layer: f"{root}/{layer}" for layer in MODEL_LAYERS}
    write_day(arrivals, paths["raw"], day)
    write_day(clean_median(read_day(spark, paths["raw"], day), exact=True), paths["clean"], day)
    earlier = load_model(spark, f"{root}/models", before=day)
    own = fit_day(spark, root, day, classifier)
    model = own if earlier is None else earlier

    scored = modelling.model_score(read_day(spark, paths["clean"], day), model)
    slots = vector_to_array("features")
    write_day(
        scored.select(KEY, *(slots[i].alias(name) for i, name in enumerate(FEATURES))),
        paths["features"],
        day,
    )
    clean = read_day(spark, paths["clean"], day).columns
    banded = with_risk(scored.select(*clean, modelling.SCORE), strict=True)
    write_day(banded, paths["scored"], day)
    return paths
