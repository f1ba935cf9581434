"""Category indexes, feature vectors, splits, models and their measures."""

import pytest
from conftest import values
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast.operators import features, modelling
from holdfast.operators.cleaning import clean_median, clean_zero
from holdfast.operators.features import FEATURES
from holdfast.operators.scoring import rule_score, with_risk
from holdfast.operators.summary import band_summary
from holdfast.schema import CATEGORIES, KEY, SCORE, TARGET, text_columns
from holdfast.session import fresh_dir
from holdfast.sources.subscribers import subscribers

MEDIUM = "/root/testdata/sf0.01"


def test_index_order_and_extra_index(spark):
    rows = [("No",), ("No",), ("Yes",), (None,), ("Yes",)]
    df = spark.createDataFrame(rows, "Churn string")
    got = features.with_category_index(df, ["Churn"])
    assert [r.Churn_index for r in got.collect()] == [0, 0, 1, 2, 1]
    labels = sorted(values(features.category_labels(df, ["Churn"])))
    assert labels == [("Churn", "No", 2, 0.0), ("Churn", "Yes", 2, 1.0)]


def test_labels_and_indexer_agree(spark, people):
    clean = clean_zero(people)
    names = [*CATEGORIES, TARGET]
    indexed = features.with_category_index(clean, names)
    for r in features.category_labels(clean, names).collect():
        seen = indexed.where(F.col(r["column"]) == r.label).select(f"{r['column']}_index").distinct()
        assert values(seen) == [(r["index"],)]


@pytest.mark.parametrize("frequent", [0, 2, 1000])
def test_joined_index_equals_the_indexer(spark, people, frequent):
    clean = clean_zero(people).withColumn(
        "PaymentMethod", F.when(F.col(KEY) != "5", F.col("PaymentMethod"))
    )
    joined = features.with_joined_index(clean, "PaymentMethod", frequent)
    fitted = features.with_category_index(clean, ["PaymentMethod"])
    columns = [KEY, "PaymentMethod", "PaymentMethod_index"]
    assert sorted(map(str, values(joined, *columns))) == sorted(
        map(str, values(fitted, *columns))
    )
    assert joined.columns == fitted.columns


@pytest.mark.parametrize("frequent", [0, 2, 1000])
def test_joined_index_of_all_columns_equals_the_indexer(spark, people, frequent):
    clean = clean_zero(people).withColumn("Churn", F.when(F.col(KEY) != "7", F.col("Churn")))
    names = [*CATEGORIES, TARGET] if frequent == 1000 else ["Contract", "PaymentMethod", TARGET]
    joined = features.with_joined_index(clean, names, frequent)
    fitted = features.with_category_index(clean, names)
    assert joined.columns == fitted.columns
    assert sorted(map(str, values(joined))) == sorted(map(str, values(fitted)))


def test_joined_index_of_a_column_without_labels(spark):
    df = spark.createDataFrame([("1", None, "x"), ("2", None, "y")], f"{KEY} string, a string, b string")
    got = values(features.with_joined_index(df, ["a", "b"]).orderBy(KEY), "a_index", "b_index")
    assert got == [(0.0, 0.0), (0.0, 1.0)]
    assert values(features.with_joined_index(df.limit(0), ["a", "b"])) == []


def test_unseen_labels_share_the_extra_index(spark):
    seen = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    model = features.category_indexer(["c"]).fit(seen)
    later = spark.createDataFrame([("z",), (None,), ("b",)], "c string")
    assert values(model.transform(later), "c_index") == [(2.0,), (2.0,), (1.0,)]


def test_categories_exclude_key_and_cleaned_totals(people):
    raw, clean = text_columns(people.schema), text_columns(clean_zero(people).schema)
    assert "TotalCharges" in raw and "TotalCharges" not in clean
    assert sorted(clean) == sorted([*CATEGORIES, TARGET]) and KEY not in clean


def test_assembler_skips_incomplete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, float("nan")), (1.0, None)], "a double, b double")
    got = features.assembler(["a", "b"]).transform(df)
    assert values(got.select(vector_to_array("features"))) == [([1.0, 2.0],)]


def test_feature_vector_has_19_slots_in_order(people):
    indexed = features.with_category_index(clean_median(people), CATEGORIES)
    row = features.unpacked(features.assembler().transform(indexed)).first()
    assert len(FEATURES) == 19 and row.__fields__ == [KEY, *FEATURES]


def test_index_label_needs_the_cast(spark, people):
    rows = features.with_category_index(clean_median(people), [*CATEGORIES, TARGET])
    vectors = features.assembler().transform(rows)
    model = LogisticRegression(maxIter=2, family="binomial")
    with pytest.raises(Exception, match="found 3"):
        model.fit(vectors.withColumn("label", F.col("Churn_index")))
    assert model.fit(features.frequency_label(vectors)).numClasses == 2


def test_frequency_label_flips_when_leavers_are_the_majority(spark):
    df = spark.createDataFrame([("Yes",), ("Yes",), ("No",)], "Churn string")
    by_index = features.frequency_label(features.with_category_index(df, ["Churn"]))
    assert [r.label for r in by_index.collect()] == [0, 0, 1]
    assert [r.label for r in features.outcome_label(df).collect()] == [1, 1, 0]


def test_rows_without_a_known_outcome_are_not_learned_from(spark):
    df = spark.createDataFrame([("Yes",), (None,), ("maybe",), ("No",)], "Churn string")
    assert [r.label for r in features.outcome_label(df).collect()] == [1, 0]


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_split_is_disjoint_whole_and_stable(spark, parts):
    keys = spark.range(5000).select(F.col("id").cast("string").alias(KEY))
    learn, test = features.split(keys.repartition(parts))
    a, b = {r[0] for r in learn.collect()}, {r[0] for r in test.collect()}
    assert not a & b and len(a | b) == 5000
    assert abs(len(a) / 5000 - 0.7) < 0.03
    assert a == {r[0] for r in features.split(keys.coalesce(1))[0].collect()}


def test_random_split_is_whole(spark):
    learn, test = features.random_split(spark.range(1000))
    assert learn.count() + test.count() == 1000


@pytest.fixture(scope="module")
def trained(spark):
    rows = subscribers(spark, MEDIUM)
    model, test = modelling.train(rows)
    return rows, model, modelling.model_score(test, model).cache()


def test_model_beats_chance_and_auc_forms_agree(trained):
    _, _, scored = trained
    (exact,) = values(modelling.exact_auc(scored, SCORE))[0]
    (binned,) = values(modelling.evaluator_auc(scored))[0]
    assert 0.7 < exact <= 1.0
    assert binned == pytest.approx(exact, abs=1e-9)


def test_prediction_is_strict_at_one_half(trained):
    _, _, scored = trained
    for r in modelling.predictions(scored, KEY).collect():
        assert r.prediction == int(r.probability > 0.5) == int(r.margin > 0)


def test_probability_follows_from_the_coefficients(trained):
    _, model, scored = trained
    lr = model.stages[-1]
    r = scored.first()
    margin = lr.intercept + lr.coefficients.dot(r.features)
    assert r[SCORE] == pytest.approx(1 / (1 + 2.718281828459045 ** -margin), rel=1e-9)


def test_bands_run_on_either_score(trained):
    rows, model, scored = trained
    by_model = band_summary(with_risk(scored, strict=True)).collect()
    by_rule = band_summary(with_risk(rule_score(rows))).collect()
    assert [r[0] for r in by_model] == [r[0] for r in by_rule]
    assert sum(r.Total_Clientes or 0 for r in by_model) == scored.count()


def test_model_survives_saving(spark, trained):
    rows, model, scored = trained
    path = fresh_dir(spark, "model")
    model.save(path)
    again = modelling.model_score(modelling.prepared(rows), PipelineModel.load(path))
    kept = {r[KEY]: r[SCORE] for r in again.select(KEY, SCORE).collect()}
    for r in scored.select(KEY, SCORE).collect():
        assert kept[r[KEY]] == pytest.approx(r[SCORE], rel=1e-9)


def test_fit_on_train_leaves_test_rows_unseen(spark):
    rows = subscribers(spark, MEDIUM)
    model, test = modelling.train(rows, fit_on="train")
    learn, _ = features.split(modelling.prepared(rows))
    counts = features.category_labels(learn, ["PaymentMethod"]).orderBy("index")
    column = CATEGORIES.index("PaymentMethod")
    assert [r.label for r in counts.collect()] == list(model.stages[1].labelsArray[column])
    assert test.count() + learn.count() == rows.count()


def test_customers_without_outcome_are_scored(spark):
    rows = subscribers(spark, MEDIUM).limit(150)
    open_ones = rows.withColumn(TARGET, F.when(F.col(KEY).cast("int") % 9 != 0, F.col(TARGET)))
    model, _ = modelling.train(open_ones)
    scored = modelling.model_score(modelling.scorable(open_ones), model)
    assert scored.where(F.col(SCORE).between(0, 1)).count() == 150


def test_trees_take_more_labels_than_their_default_bins(spark):
    rows = subscribers(spark, MEDIUM).withColumn(
        "PaymentMethod", F.concat(F.lit("m"), F.col(KEY).cast("int") % 40)
    )
    for classifier in (modelling.forest(2), modelling.boosted(1)):
        model, test = modelling.train(rows, classifier)
        assert modelling.model_score(test, model).count() == test.count()


def test_joined_index_keeps_columns_with_any_name(spark):
    df = spark.createDataFrame([(7, "a", "k1", "p"), (8, None, "k2", "q")], f"open int, c string, {KEY} string, probe string")
    got = features.with_joined_index(df.withColumns({"top_index": F.lit(3), "value": F.lit(4), "row": F.lit(5)}), "c", 0)
    assert sorted(values(got, "open", "probe", "top_index", "value", "row", "c_index")) == [
        (7, "p", 3, 4, 5, 0.0), (8, "q", 3, 4, 5, 1.0),
    ]


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_trees_beat_chance(spark, kind):
    classifier = modelling.forest(5) if kind == "forest" else modelling.boosted(3)
    model, test = modelling.train(subscribers(spark, MEDIUM), classifier)
    (auc,) = values(modelling.exact_auc(modelling.model_score(test, model), SCORE))[0]
    assert auc > 0.7
