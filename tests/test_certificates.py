"""Certificates tell right from wrong, model days, and usage features by brute force."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from conftest import values
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from holdfast.operators import certify, cleaning, features, modelling, usage
from holdfast.plans.daily import run_model_day
from holdfast.schema import FLAG, KEY, SCORE
from holdfast.session import fresh_dir
from holdfast.sources.models import load_model, model_days
from holdfast.sources.sinks import read_day


def agreement(df):
    return values(df.agg(F.avg(F.col("probability_agrees").cast("int"))))[0][0]


@pytest.fixture(scope="module")
def fits(spark, people):
    made = {"logistic": modelling.logistic(), "forest": modelling.forest(5)}
    made["boosted"] = modelling.boosted(4)
    return {k: modelling.train(people, c) for k, c in made.items()}


def again(spark, kind, model):
    if kind == "logistic":
        return certify.sigmoid(certify.logistic_margin(model))
    walk = certify.forest_probability if kind == "forest" else certify.boosted_probability
    return walk(spark, model)


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
def test_recomputed_scores_agree(spark, fits, kind):
    model, test = fits[kind]
    found = certify.certified(test, model, again(spark, kind, model), KEY)
    assert agreement(found) == 1.0
    assert values(found.agg(F.bool_and("prediction_agrees")))[0][0]


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
def test_a_wrong_score_is_found_out(spark, fits, kind):
    model, test = fits[kind]
    off = again(spark, kind, model) + F.when(F.col(KEY).cast("int") % 2 == 0, 1e-6).otherwise(0.0)
    share = agreement(certify.certified(test, model, off, KEY))
    assert 0.2 < share < 0.8


def test_categorical_and_missing_splits(spark, people):
    """Walks also hold for rows whose categories no training row had."""
    model, test = modelling.train(people, modelling.forest(8))
    odd = test.withColumn("PaymentMethod", F.lit("never seen")).withColumn("tenure", F.lit(10_000))
    assert agreement(certify.certified(odd, model, certify.forest_probability(spark, model))) == 1.0


def test_moments_hold_at_the_optimum_only(spark, people):
    rows = features.outcome_label(cleaning.clean_median(people, exact=True)).cache()
    steps = [features.category_indexer(features.CATEGORIES), features.assembler()]
    preparation = Pipeline(stages=steps).fit(rows)
    learn = preparation.transform(rows)
    for iterations, all_hold in ((1, False), (500, True)):
        fitted = modelling.logistic(iterations).setTol(1e-12).fit(learn)
        model = PipelineModel(stages=[*preparation.stages, fitted])
        found = certify.moments(rows, model, features.FEATURES)
        assert values(found.agg(F.bool_and("agrees")))[0][0] is all_hold
    assert values(certify.beats_null(rows, model).select("beats_null")) == [(True,)]


def test_median_rank(spark):
    numbers = [float(i) for i in range(1000)] + [None, float("nan")]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    told = {
        answer: values(certify.median_rank(df, "x", F.lit(answer)))[0]
        for answer in (499.0, 500.0, 498.5, 490.0, 510.0)
    }
    assert told[499.0] == told[500.0] == (1000, True, True)
    assert told[498.5] == (1000, True, False)
    assert told[490.0] == told[510.0] == (1000, False, True)
    same = spark.createDataFrame([(1.0,)] * 10, "x double")
    assert values(certify.median_rank(same, "x", F.lit(1.0))) == [(10, True, True)]


def test_model_days(spark, people):
    root = fresh_dir(spark, "layers")
    paths = run_model_day(spark, people, root, "2024-01-01")
    first = load_model(spark, f"{root}/models", before="2024-01-02")
    assert load_model(spark, f"{root}/models", before="2024-01-01") is None
    # The next day's customers have turned, which must not change their scores.
    turned = people.withColumn("Churn", F.when(F.col("Churn") == "Yes", "No").otherwise("Yes"))
    run_model_day(spark, turned, root, "2024-01-02")
    assert model_days(spark, f"{root}/models") == ["2024-01-01", "2024-01-02"]

    def scored(day):
        return sorted(values(read_day(spark, paths["scored"], day), KEY, SCORE, FLAG))

    want = modelling.model_score(read_day(spark, paths["clean"], "2024-01-02"), first)
    assert [r[:2] for r in scored("2024-01-02")] == sorted(values(want, KEY, SCORE))
    assert [r[:2] for r in scored("2024-01-01")] == [r[:2] for r in scored("2024-01-02")]
    # A second run of a day changes neither that day nor another.
    before = scored("2024-01-01"), scored("2024-01-02")
    run_model_day(spark, turned, root, "2024-01-02")
    assert (scored("2024-01-01"), scored("2024-01-02")) == before
    # Rows without an outcome are scored, not learned from; the third day uses the second model.
    unknown = people.withColumn("Churn", F.lit(None).cast("string"))
    run_model_day(spark, unknown.union(people), root, "2024-01-03")
    assert len(scored("2024-01-03")) == 2 * people.count()
    layer = read_day(spark, paths["features"], "2024-01-03")
    assert layer.columns == [KEY, *features.FEATURES] and layer.count() == 2 * people.count()


ORDERS = "o_custkey bigint, o_orderdate timestamp, o_totalprice double"


def day(text):
    return datetime.datetime.fromisoformat(text)


def test_cycle_days_lie_on_a_circle(spark):
    rows = [
        # Around the turn of the month: 31, 1, 1, 2 weigh most at 1.
        *((1, day(d), 10.0) for d in ("2024-01-31", "2024-03-01", "2024-04-01", "2024-05-02")),
        # Equal weights: the smallest day.
        *((2, day(d), 10.0) for d in ("2024-01-10", "2024-02-20")),
        (3, day("2024-01-31"), 10.0),
        (None, day("2024-01-31"), 10.0),
        (4, None, 10.0),
    ]
    found = {
        (r.o_custkey, str(r.month)): (r.cycle_day, r.n_orders)
        for r in usage.repaired_cycles(spark.createDataFrame(rows, ORDERS)).collect()
    }
    # The bill of January 31 is early: its cycle starts on February 1.
    assert found[1, "2024-02-01"] == (1, 1) and found[1, "2024-03-01"] == (1, 1)
    assert found[2, "2024-01-01"] == (10, 1) and found[2, "2024-02-01"] == (10, 1)
    assert found[3, "2024-01-01"] == (31, 1)
    assert {k[0] for k in found} == {1, 2, 3}


def test_cycle_days_equal_brute_force(spark):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (rng.randrange(20), start + datetime.timedelta(rng.randrange(700)), 1.0)
        for _ in range(600)
    ]
    weights, own = defaultdict(Counter), defaultdict(Counter)
    for customer, at, _ in rows:
        own[customer][at.day] += 1
        for k in (-1, 0, 1):
            weights[customer][(at.day - 1 + k) % 31 + 1] += 1
    want = {c: min(w, key=lambda d: (-w[d], -own[c][d], d)) for c, w in weights.items()}
    days = F.to_date("o_orderdate").alias("billed_on")
    orders = spark.createDataFrame(rows, ORDERS)
    daily = orders.groupBy("o_custkey", days).agg(F.count("*").alias("n"))
    assert dict(values(usage.cycle_days(daily))) == want


def test_as_of_features_see_nothing_at_or_after_the_cutoff(spark):
    orders = [
        (1, day("2024-01-01"), 5.0), (1, day("2024-01-10"), 7.0),
        (2, day("2024-03-01"), 1.0), (None, day("2024-01-01"), 1.0),
    ]
    events = [
        (1, day("2024-01-09"), 2.0), (3, day("2024-01-05"), None), (1, day("2024-01-20"), 9.0)
    ]

    def run(more_orders=(), more_events=(), cutoffs=("2024-01-10", "2024-03-01", "2023-01-01")):
        o = spark.createDataFrame([*orders, *more_orders], ORDERS)
        e = spark.createDataFrame(
            [*events, *more_events], "user_id bigint, ts timestamp, value double"
        )
        found = usage.as_of_features(o, e, cutoffs).collect()
        return {(r.customer, str(r.cutoff)): tuple(r)[2:] for r in found}

    got = run()
    assert got == {
        (1, "2024-01-10"): (1, 5.0, 9, 1, 2.0, 1, 0),
        (3, "2024-01-10"): (0, 0.0, None, 1, 0.0, 5, 1),
        (1, "2024-03-01"): (2, 12.0, 51, 2, 11.0, 41, 1),
        (3, "2024-03-01"): (0, 0.0, None, 1, 0.0, 56, 1),
    }
    # What happens later changes the label at most.
    later = run([(1, day("2024-01-10"), 100.0)], [(3, day("2024-01-10"), 50.0)])
    assert later[1, "2024-01-10"] == got[1, "2024-01-10"]
    assert later[3, "2024-01-10"][:-1] == got[3, "2024-01-10"][:-1]
    assert later[3, "2024-01-10"][-1] == 0
