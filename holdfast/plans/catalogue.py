"""Every report by name: callables of (session, table folder) that return a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.numbers import money_sum, round_even
from holdfast.functions.risk import risk_band
from holdfast.operators import (
    certify,
    charts,
    cleaning,
    features,
    modelling,
    profiling,
    summary,
    usage,
)
from holdfast.operators.ordered import exact_quantiles
from holdfast.operators.scoring import critical_profile, rule_score, with_risk
from holdfast.plans.daily import run_day, run_model_day
from holdfast.schema import (
    BAND,
    CATEGORIES,
    FLAG,
    HIGH_ABOVE,
    KEY,
    LEFT,
    SCORE,
    TARGET,
    text_columns,
)
from holdfast.session import cut_lineage, fresh_dir
from holdfast.sources.models import load_model
from holdfast.sources.readers import read_csv, read_csv_tokens, table
from holdfast.sources.sinks import read_day, write_csv, write_result
from holdfast.sources.subscribers import subscribers

Query = Callable[[SparkSession, str], DataFrame]

CATALOGUE: dict[str, Query] = {}

DAY = "2001-08-01"
NEXT_DAY = "2001-08-02"

# Cutoffs of the look-ahead features, among orders and among usage events.
CUTOFFS = ("2001-05-01", "2001-07-02", "2024-01-16")


def report(build: Query) -> Query:
    CATALOGUE[build.__name__] = build
    return build


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_zero(subscribers(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_risk(rule_score(cleaned(spark, sf_dir)))


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribers of whom every 50th has no payment method and every 70th no charges."""
    number = F.col(KEY).cast("bigint")
    return subscribers(spark, sf_dir).withColumns(
        {
            "PaymentMethod": F.when(number % 50 != 0, F.col("PaymentMethod")),
            "MonthlyCharges": F.when(number % 70 != 0, F.col("MonthlyCharges")),
        }
    )


def leavers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).where(F.col(TARGET) == LEFT)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: round_even(F.col(c), digits) for c in columns})


# --- scans and sinks ---------------------------------------------------------


@report
def csv_scan_inferred(spark, sf_dir):
    path = write_csv(subscribers(spark, sf_dir), fresh_dir(spark, "csv"))
    return read_csv(spark, path, schema=None).withColumn(KEY, F.col(KEY).cast("string"))


@report
def csv_scan_declared(spark, sf_dir):
    path = write_csv(subscribers(spark, sf_dir), fresh_dir(spark, "csv"))
    return read_csv(spark, path)


@report
def csv_scan_reordered(spark, sf_dir):
    rows = subscribers(spark, sf_dir)
    return read_csv(spark, write_csv(rows.select(*rows.columns[::-1]), fresh_dir(spark, "csv")))


@report
def csv_scan_tokens(spark, sf_dir):
    path = write_csv(with_gaps(spark, sf_dir), fresh_dir(spark, "csv"), missing="n/a")
    return read_csv_tokens(spark, path)


@report
def result_sink_roundtrip(spark, sf_dir):
    result = summary.band_summary(scored(spark, sf_dir))
    return spark.read.parquet(write_result(result, fresh_dir(spark, "result")))


# --- profile -----------------------------------------------------------------


@report
def table_shape(spark, sf_dir):
    return profiling.shape(subscribers(spark, sf_dir))


@report
def schema_listing(spark, sf_dir):
    return profiling.schema_listing(cleaned(spark, sf_dir))


@report
def profile_all(spark, sf_dir):
    # Counted as text and ranked as numbers: written once.
    return profiling.describe_all(cut_lineage(subscribers(spark, sf_dir)), digits=4)


@report
def profile_numeric(spark, sf_dir):
    return profiling.describe_numeric(cleaned(spark, sf_dir), "TotalCharges")


@report
def missing_counts(spark, sf_dir):
    return profiling.missing_counts(with_gaps(spark, sf_dir))


@report
def missing_counts_wide(spark, sf_dir):
    cast = subscribers(spark, sf_dir).withColumn(
        "TotalCharges", cleaning.to_double(F.col("TotalCharges"))
    )
    return profiling.missing_wide(cast, ["MonthlyCharges", "TotalCharges"])


@report
def missing_after_median(spark, sf_dir):
    filled = cleaning.clean_median(subscribers(spark, sf_dir))
    return profiling.missing_wide(filled, ["MonthlyCharges", "TotalCharges"])


@report
def head_transposed(spark, sf_dir):
    return profiling.head_transposed(subscribers(spark, sf_dir), KEY)


# --- cleaning ----------------------------------------------------------------


@report
def clean_zero(spark, sf_dir):
    return cleaned(spark, sf_dir)


@report
def clean_median(spark, sf_dir):
    return cleaning.clean_median(subscribers(spark, sf_dir), exact=True)


@report
def clean_median_approx(spark, sf_dir):
    return cleaning.clean_median(subscribers(spark, sf_dir))


@report
def median_exact(spark, sf_dir):
    return summary.exact_median(leavers(spark, sf_dir), "tenure")


@report
def median_charges_by_churn(spark, sf_dir):
    medians = exact_quantiles(cleaned(spark, sf_dir), "MonthlyCharges", [0.5], [TARGET])
    return rounded(medians, "value")


@report
def median_discrete(spark, sf_dir):
    return cleaning.middle_element(
        subscribers(spark, sf_dir).withColumn(
            "TotalCharges", cleaning.to_double(F.col("TotalCharges"))
        ),
        "TotalCharges",
    )


@report
def median_approx(spark, sf_dir):
    cast = subscribers(spark, sf_dir).withColumn(
        "TotalCharges", cleaning.to_double(F.col("TotalCharges"))
    )
    return cleaning.approx_median(cast, "TotalCharges")


@report
def incomplete_rows(spark, sf_dir):
    cast = subscribers(spark, sf_dir).withColumn(
        "TotalCharges", cleaning.to_double(F.col("TotalCharges"))
    )
    return cleaning.incomplete_rows(cast, ["SeniorCitizen", "tenure", "TotalCharges"])


@report
def complete_rows(spark, sf_dir):
    cast = with_gaps(spark, sf_dir).withColumn(
        "TotalCharges", cleaning.to_double(F.col("TotalCharges"))
    )
    kept = cleaning.drop_incomplete(cast, ["tenure", "MonthlyCharges", "TotalCharges"])
    return kept.select(KEY, "tenure", "MonthlyCharges", "TotalCharges")


# --- scores, bands, revenue --------------------------------------------------


@report
def risk_band_summary(spark, sf_dir):
    return summary.band_summary(scored(spark, sf_dir))


@report
def mrr_at_risk(spark, sf_dir):
    return summary.revenue_at_risk(scored(spark, sf_dir))


@report
def scored_customers(spark, sf_dir):
    return scored(spark, sf_dir)


@report
def scored_preview(spark, sf_dir):
    first = profiling.first_rows(scored(spark, sf_dir), KEY)
    return first.select(KEY, "Contract", "MonthlyCharges", SCORE, FLAG)


@report
def critical_customers(spark, sf_dir):
    chosen = subscribers(spark, sf_dir).where(critical_profile())
    return chosen.select(KEY, "InternetService", "Contract")


@report
def band_counts(spark, sf_dir):
    return summary.band_counts(scored(spark, sf_dir))


@report
def band_mrr_bars(spark, sf_dir):
    return summary.band_bars(summary.band_summary(scored(spark, sf_dir)))


# --- who leaves --------------------------------------------------------------


@report
def leaver_rows(spark, sf_dir):
    return leavers(spark, sf_dir).select(KEY, "tenure", TARGET)


@report
def churn_by_contract(spark, sf_dir):
    return summary.counts_by(cleaned(spark, sf_dir), "Contract")


@report
def churn_by_internet(spark, sf_dir):
    return summary.counts_by(cleaned(spark, sf_dir), "InternetService")


@report
def churn_by_support(spark, sf_dir):
    return summary.counts_by(cleaned(spark, sf_dir), "TechSupport")


@report
def leaving_rate(spark, sf_dir):
    return summary.leaving_rate(cleaned(spark, sf_dir))


@report
def leaving_rate_by_contract(spark, sf_dir):
    return summary.leaving_rate(cleaned(spark, sf_dir), "Contract")


# --- charts ------------------------------------------------------------------


@report
def leaver_tenure_histogram(spark, sf_dir):
    return charts.histogram(leavers(spark, sf_dir), "tenure")


@report
def leaver_tenure_density(spark, sf_dir):
    return rounded(charts.density(leavers(spark, sf_dir), "tenure"), "x", "y")


@report
def charges_box_by_churn(spark, sf_dir):
    box = charts.box_stats(cleaned(spark, sf_dir), TARGET, "MonthlyCharges")
    return rounded(box, "q1", "median", "q3", "whisker_lo", "whisker_hi")


@report
def score_box_by_contract(spark, sf_dir):
    box = charts.box_stats(scored(spark, sf_dir), "Contract", SCORE)
    return rounded(box, "q1", "median", "q3", "whisker_lo", "whisker_hi", digits=9)


@report
def chart_reference_lines(spark, sf_dir):
    median = summary.exact_median(leavers(spark, sf_dir), "tenure")
    return charts.reference_lines(
        spark, {"median tenure of leavers": median, "high risk": HIGH_ABOVE}
    )


@report
def tenure_charges_grid(spark, sf_dir):
    return charts.scatter_grid(scored(spark, sf_dir), "tenure", "MonthlyCharges", 6.0, 10.0)


@report
def tenure_charges_points(spark, sf_dir):
    return charts.scatter_points(scored(spark, sf_dir), "tenure", "MonthlyCharges")


@report
def tenure_charges_sample(spark, sf_dir):
    return charts.scatter_points(scored(spark, sf_dir), "tenure", "MonthlyCharges", share=0.1)


# --- features ----------------------------------------------------------------


@report
def categorical_columns(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    return features.label_counts(rows, text_columns(rows.schema))


@report
def category_labels(spark, sf_dir):
    return features.category_labels(cleaned(spark, sf_dir), [*CATEGORIES, TARGET])


@report
def category_labels_ranked(spark, sf_dir):
    return features.category_labels(cleaned(spark, sf_dir), [*CATEGORIES, TARGET])


@report
def payment_index_joined(spark, sf_dir):
    indexed = features.with_joined_index(with_gaps(spark, sf_dir), "PaymentMethod")
    return indexed.select(KEY, "PaymentMethod", "PaymentMethod_index")


@report
def category_index(spark, sf_dir):
    names = [*CATEGORIES, TARGET]
    indexed = features.with_category_index(cut_lineage(cleaned(spark, sf_dir)), names)
    return indexed.select(KEY, *(f"{c}_index" for c in names))


@report
def category_index_joined(spark, sf_dir):
    names = [*CATEGORIES, TARGET]
    indexed = features.with_joined_index(cut_lineage(cleaned(spark, sf_dir)), names)
    return indexed.select(KEY, *(f"{c}_index" for c in names))


@report
def assembled_features(spark, sf_dir):
    # Median, index and vector all read the rows: written once.
    filled = cleaning.clean_median(cut_lineage(subscribers(spark, sf_dir)), exact=True)
    indexed = features.with_category_index(filled, CATEGORIES)
    return features.unpacked(features.assembler().transform(indexed))


@report
def label_column(spark, sf_dir):
    indexed = features.with_category_index(cleaned(spark, sf_dir), [TARGET])
    return features.frequency_label(indexed).select(KEY, "label")


@report
def train_test_split(spark, sf_dir):
    learn, test = features.split(subscribers(spark, sf_dir).select(KEY))
    return learn.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


# --- models ------------------------------------------------------------------


@report
def model_scores(spark, sf_dir):
    model, test = modelling.train(subscribers(spark, sf_dir))
    return modelling.predictions(modelling.model_score(test, model), KEY)


@report
def model_risk_bands(spark, sf_dir):
    rows = subscribers(spark, sf_dir)
    model, _ = modelling.train(rows)
    banded = with_risk(modelling.model_score(modelling.scorable(rows), model), strict=True)
    return summary.band_summary(banded)


@report
def model_scored_customers(spark, sf_dir):
    """Every customer is scored, also those whose outcome is not known yet."""
    number = F.col(KEY).cast("bigint")
    rows = subscribers(spark, sf_dir).withColumn(TARGET, F.when(number % 10 != 0, F.col(TARGET)))
    model, _ = modelling.train(rows)
    score = F.col(SCORE)
    return modelling.model_score(modelling.scorable(rows), model).select(
        KEY, TARGET, score.between(0, 1).cast("int").alias("is_scored")
    )


@report
def model_auc(spark, sf_dir):
    model, test = modelling.train(subscribers(spark, sf_dir))
    return modelling.evaluator_auc(model.transform(test))


@report
def model_auc_train_only_fit(spark, sf_dir):
    model, test = modelling.train(subscribers(spark, sf_dir), fit_on="train")
    return modelling.exact_auc(modelling.model_score(test, model), SCORE)


@report
def forest_scores(spark, sf_dir):
    model, test = modelling.train(subscribers(spark, sf_dir), modelling.forest())
    return modelling.predictions(modelling.model_score(test, model), KEY)


@report
def boosted_scores(spark, sf_dir):
    model, test = modelling.train(subscribers(spark, sf_dir), modelling.boosted())
    return modelling.predictions(modelling.model_score(test, model), KEY)


# --- models and sketches, recomputed -----------------------------------------


@report
def model_scores_certified(spark, sf_dir):
    model, test = modelling.train(subscribers(spark, sf_dir))
    again = certify.sigmoid(certify.logistic_margin(model))
    return certify.certified(test, model, again, KEY)


@report
def forest_scores_certified(spark, sf_dir):
    model, test = modelling.train(subscribers(spark, sf_dir), modelling.forest())
    return certify.certified(test, model, certify.forest_probability(spark, model), KEY)


@report
def boosted_scores_certified(spark, sf_dir):
    model, test = modelling.train(subscribers(spark, sf_dir), modelling.boosted())
    return certify.certified(test, model, certify.boosted_probability(spark, model), KEY)


@report
def model_bands_certified(spark, sf_dir):
    """Customers and revenue over all bands, and whether recomputed scores give the same bands."""
    rows = modelling.scorable(subscribers(spark, sf_dir))
    model, _ = modelling.train(subscribers(spark, sf_dir))
    scores = modelling.model_score(rows, model)
    again = certify.sigmoid(certify.logistic_margin(model))
    told = scores.withColumn(certify.SLOTS, vector_to_array("features"))
    both = with_risk(told, strict=True).withColumn("again", risk_band(again))
    return both.agg(
        F.count(F.lit(1)).alias("customers"),
        money_sum(F.col("MonthlyCharges")).alias("mrr"),
        F.bool_and(F.col("again") == F.col(BAND)).alias("bands_agree"),
    )


@report
def model_beats_null(spark, sf_dir):
    rows = cut_lineage(modelling.prepared(subscribers(spark, sf_dir)))
    model, _ = modelling.train(rows)
    return certify.beats_null(features.split(rows)[0], model)


@report
def model_moments(spark, sf_dir):
    """A fit that runs to its optimum reproduces the totals of every feature over the leavers."""
    filled = cleaning.clean_median(subscribers(spark, sf_dir), exact=True)
    rows = cut_lineage(features.outcome_label(filled))
    steps = [features.category_indexer(CATEGORIES), features.assembler()]
    preparation = Pipeline(stages=steps).fit(rows)
    learn = features.split(rows)[0]
    exact = modelling.logistic(500).setTol(1e-12)
    fitted = exact.fit(preparation.transform(learn))
    model = PipelineModel(stages=[*preparation.stages, fitted])
    return certify.moments(learn, model, features.FEATURES)


@report
def median_approx_certified(spark, sf_dir):
    cast = modelling.scorable(subscribers(spark, sf_dir))
    answer = cleaning.approx_median(cast, "TotalCharges").scalar()
    return certify.median_rank(cast, "TotalCharges", answer)


@report
def median_fill_certified(spark, sf_dir):
    """The values that the approximate median filled in, held against the known ones."""
    rows = subscribers(spark, sf_dir)
    known = modelling.scorable(rows).select(KEY, F.col("TotalCharges").alias("known"))
    filled = cut_lineage(cleaning.clean_median(rows).join(known, KEY))
    gaps = filled.where("known is null")
    answer = gaps.agg(F.max("TotalCharges")).scalar()
    ranked = certify.median_rank(filled, "known", answer)
    return ranked.withColumns(
        {
            "n_filled": gaps.agg(F.count("TotalCharges")).scalar(),
            "n_values": gaps.agg(F.count_distinct("TotalCharges")).scalar(),
        }
    )


@report
def preparation_reloaded(spark, sf_dir):
    """The preparation fitted, stored, loaded and applied: the features that it gives."""
    rows = cut_lineage(cleaning.clean_median(subscribers(spark, sf_dir), exact=True))
    steps = [features.category_indexer(CATEGORIES), features.assembler()]
    path = fresh_dir(spark, "preparation")
    Pipeline(stages=steps).fit(rows).save(path)
    return features.unpacked(PipelineModel.load(path).transform(rows))


def labelled_rule_scores(spark, sf_dir):
    return features.outcome_label(scored(spark, sf_dir))


@report
def auc_exact(spark, sf_dir):
    auc = modelling.exact_auc(labelled_rule_scores(spark, sf_dir), SCORE)
    return rounded(auc, "auc", digits=10)


@report
def auc_evaluator(spark, sf_dir):
    auc = modelling.evaluator_auc(labelled_rule_scores(spark, sf_dir), raw=SCORE)
    return rounded(auc, "auc", digits=10)


@report
def recall_threshold(spark, sf_dir):
    return modelling.recall_threshold(labelled_rule_scores(spark, sf_dir), SCORE)


# --- layers, joins, repairs, usage -------------------------------------------


@report
def daily_layer_readback(spark, sf_dir):
    layers = run_day(spark, subscribers(spark, sf_dir), fresh_dir(spark, "layers"), DAY)
    return read_day(spark, layers["scored"], DAY)


def two_days(spark, sf_dir):
    """Layers of two days: the first day's model scores the second, which arrives with gaps."""
    root = fresh_dir(spark, "layers")
    run_model_day(spark, subscribers(spark, sf_dir), root, DAY)
    return run_model_day(spark, with_gaps(spark, sf_dir), root, NEXT_DAY), root


@report
def daily_feature_layer(spark, sf_dir):
    layers, _ = two_days(spark, sf_dir)
    return read_day(spark, layers["features"], NEXT_DAY)


@report
def daily_model_scored(spark, sf_dir):
    """The second day's scored rows, recomputed from its feature layer and the stored model."""
    layers, root = two_days(spark, sf_dir)
    model = load_model(spark, f"{root}/models", before=NEXT_DAY)
    slots = F.array(*(F.col(f) for f in features.FEATURES)).alias(certify.SLOTS)
    vectors = read_day(spark, layers["features"], NEXT_DAY).select(KEY, slots)
    again = certify.sigmoid(certify.logistic_margin(model))
    found = read_day(spark, layers["scored"], NEXT_DAY).join(vectors, KEY)
    return found.withColumn(
        "certified",
        certify.close(F.col(SCORE), again)
        & (F.col(FLAG) == (again > 0.5).cast("int"))
        & (F.col(BAND) == risk_band(again)),
    ).drop(SCORE, FLAG, BAND, certify.SLOTS)


@report
def customer_view(spark, sf_dir):
    names = ("customer", "nation", "region", "orders", "events")
    return usage.customer_view(*(table(spark, sf_dir, n) for n in names))


@report
def complaints_deduplicated(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    kept = usage.keep_latest(documents, [F.col("text")], "doc_id")
    return kept.select("doc_id", "source", "lang", "n_chars")


@report
def billing_cycles(spark, sf_dir):
    return usage.billing_cycles(table(spark, sf_dir, "orders"), cycle_day=5)


@report
def look_ahead_labels(spark, sf_dir):
    return usage.look_ahead_labels(table(spark, sf_dir, "orders"))


@report
def billing_cycles_repaired(spark, sf_dir):
    return usage.repaired_cycles(table(spark, sf_dir, "orders"))


@report
def as_of_features(spark, sf_dir):
    orders, events = (table(spark, sf_dir, n) for n in ("orders", "events"))
    return usage.as_of_features(orders, events, CUTOFFS)


@report
def arpu_by_internet(spark, sf_dir):
    arpu = usage.revenue_per_user(cleaned(spark, sf_dir), "InternetService")
    return rounded(arpu, "arpu")


@report
def complaint_text_features(spark, sf_dir):
    return usage.complaint_features(table(spark, sf_dir, "documents"))


@report
def usage_by_user(spark, sf_dir):
    return usage.usage_by_user(table(spark, sf_dir, "events"))


@report
def usage_by_day(spark, sf_dir):
    return usage.usage_by_day(table(spark, sf_dir, "events"))
