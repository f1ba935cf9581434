"""Exact order statistics against numpy and plain Python, whatever the partitioning."""

import random

import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from holdfast.operators.cleaning import approx_median, clean_median, middle_element
from holdfast.operators.modelling import exact_auc, recall_threshold
from holdfast.operators.ordered import (
    CHUNK,
    Chunks,
    exact_quantiles,
    in_chunks,
    running_totals,
    value_chunks,
)

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def skewed(n, seed):
    """A third of the rows share one value; the rest are spread over many magnitudes."""
    rng = random.Random(seed)
    return [7.0 if i % 3 == 0 else rng.lognormvariate(0, 3) for i in range(n)]


def frame(spark, numbers, parts=4):
    rows = [(("a" if i % 3 else "b"), float(v)) for i, v in enumerate(numbers)]
    return spark.createDataFrame(rows, "g string, x double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_quantiles_equal_numpy(spark, parts):
    numbers = skewed(5000, 1)
    got = dict(values(exact_quantiles(frame(spark, numbers, parts), "x", PROBS), "p", "value"))
    assert got == {p: pytest.approx(np.quantile(numbers, p), rel=1e-15) for p in PROBS}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10])
def test_quantiles_of_few_rows(spark, n):
    numbers = list(range(1, n + 1))
    got = dict(values(exact_quantiles(frame(spark, numbers), "x", PROBS), "p", "value"))
    assert got == {p: pytest.approx(np.quantile(numbers, p)) for p in PROBS}


def test_quantiles_per_group(spark):
    numbers = skewed(3000, 2)
    got = exact_quantiles(frame(spark, numbers), "x", [0.25, 0.5], ["g"])
    expected = {
        (g, p): pytest.approx(np.quantile([v for i, v in enumerate(numbers) if cut(i)], p))
        for g, cut in (("a", lambda i: i % 3), ("b", lambda i: i % 3 == 0))
        for p in (0.25, 0.5)
    }
    assert {(r.g, r.p): r.value for r in got.collect()} == expected


def test_many_groups_take_the_shuffled_join(spark):
    df = spark.range(2000).select((F.col("id") % 50).alias("g"), F.col("id").alias("x"))
    chunks = value_chunks(df, "x", ["g"])
    many = Chunks(chunks.rows, chunks.by, 10**9)
    plan = many.join(many.sizes())._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan
    few = running_totals(chunks, "value", ["n"]).collect()
    assert sorted(running_totals(many, "value", ["n"]).collect()) == sorted(few)


def test_running_totals_over_several_chunks(spark):
    df = spark.range(10_000).select(F.col("id").alias("x"), (F.col("id") % 7).alias("w"))
    chunks = in_chunks(df.repartition(5), "x")
    assert chunks.rows.select(CHUNK).distinct().count() > 1
    total = 0
    for r in running_totals(chunks, "x", ["w"]).orderBy("x").collect():
        assert r.w_before == total
        total += r.w


def test_missing_values_have_no_rank(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert values(exact_quantiles(df, "x", [0.5]), "value") == [(2.0,)]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert values(exact_quantiles(df, "x", [0.5])) == []


def test_even_count_median_is_element_or_midpoint(spark):
    df = frame(spark, [1, 2, 3, 4])
    assert values(middle_element(df, "x")) == [(2.0,)]
    assert values(exact_quantiles(df, "x", [0.5]), "value") == [(2.5,)]
    assert values(approx_median(df, "x")) == [(2.0,)]


def test_approximate_median_is_close_in_rank(spark):
    numbers = sorted(set(skewed(20_000, 3)))
    (got,) = values(approx_median(frame(spark, numbers), "x"))[0]
    rank = numbers.index(got) + 1
    assert abs(rank - len(numbers) / 2) <= 0.001 * len(numbers) + 1


def test_median_fill(spark):
    df = spark.createDataFrame([(" ",), ("4",), ("1",), ("9",)], "TotalCharges string")
    for exact in (True, False):
        got = sorted(values(clean_median(df, exact=exact)))
        assert got == [(1.0,), (4.0,), (4.0,), (9.0,)]


def pairs_auc(rows):
    """Brute force over all pairs."""
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auc_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, label int").repartition(7)
    (auc,) = values(exact_auc(df, "s"))[0]
    assert auc == pytest.approx(pairs_auc(rows), abs=1e-12)
    (mirrored,) = values(exact_auc(df.withColumn("s", -F.col("s")), "s"))[0]
    assert mirrored == pytest.approx(1 - auc, abs=1e-12)


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, label int")
    assert values(exact_auc(df, "s")) == [(None,)]


def test_recall_threshold_is_the_highest_that_suffices(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 1), (0.5, 1), (0.4, 0), (0.3, 1)]
    df = spark.createDataFrame(rows, "s double, label int").repartition(3)
    got = recall_threshold(df, "s").first()
    assert (got.threshold, got.tp, got.fp, got.fn, got.tn) == (0.5, 4, 1, 1, 1)
    assert got.recall == pytest.approx(0.8) and got.precision == pytest.approx(0.8)
