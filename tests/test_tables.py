"""Profiles, summaries, charts and usage operators on hand-made rows."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from holdfast.functions.numbers import parse_number
from holdfast.operators import charts, cleaning, profiling, summary, usage
from holdfast.operators.scoring import rule_score, with_risk
from holdfast.schema import BAND, BANDS, FLAG, HIGH, LOW, MEDIUM, SCORE, TARGET

D = datetime.date


def banded(spark, rows):
    return spark.createDataFrame(
        rows, f"customerID string, MonthlyCharges double, tenure int, {BAND} string"
    )


def test_absent_bands_stay_in_the_report(spark):
    got = values(summary.band_summary(banded(spark, [("1", 10.0, 3, HIGH), ("2", 5.5, 4, HIGH)])))
    assert got == [
        (HIGH, 2, 15.5, 3.5, "$15.50"),
        (MEDIUM, None, None, None, None),
        (LOW, None, None, None, None),
    ]


def test_count_skips_missing_keys(spark):
    got = values(summary.band_summary(banded(spark, [(None, 1.0, 1, LOW), ("2", 1.0, 1, LOW)])))
    assert got[2][1] == 1


def test_revenue_at_risk_of_nobody_is_zero(spark):
    got = values(summary.revenue_at_risk(banded(spark, [("1", 10.0, 3, LOW)])))
    assert got == [(0.0, 0.0, 0.0, "$0.00")]
    assert values(summary.revenue_at_risk(banded(spark, [])))[0][2] == 0.0


def test_missing_categories_are_left_out(spark):
    df = spark.createDataFrame([("x", "Yes"), (None, "Yes"), ("x", None)], f"c string, {TARGET} string")
    assert values(summary.counts_by(df, "c")) == [("x", "Yes", 1)]


def test_leaving_rate(spark):
    df = spark.createDataFrame([("x", "Yes"), ("x", "No"), ("y", "No")], f"c string, {TARGET} string")
    assert sorted(values(summary.leaving_rate(df, "c"))) == [("x", 2, 1, 0.5), ("y", 1, 0, 0.0)]
    assert values(summary.leaving_rate(df)) == [(3, 1, pytest.approx(1 / 3))]


def test_describe_equals_pandas(spark, people):
    pdf = people.toPandas()
    got = {r["column"]: r for r in profiling.describe_all(people).collect()}
    expected = pdf.describe(include="all").T
    assert set(got) == set(pdf.columns)
    for name in ("SeniorCitizen", "tenure", "MonthlyCharges"):
        for mine, theirs in (
            ("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
            ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max"),
        ):
            assert got[name][mine] == pytest.approx(float(expected.loc[name, theirs]), rel=1e-12)
    for name in ("Contract", "Churn", "TotalCharges", "customerID"):
        assert got[name]["count"] == expected.loc[name, "count"]
        assert got[name]["unique"] == expected.loc[name, "unique"]
        assert got[name]["freq"] == expected.loc[name, "freq"]


def test_describe_of_empty_columns(spark):
    df = spark.createDataFrame([(None, None, 1.0)], "t string, x double, y double")
    got = {r["column"]: r for r in profiling.describe_all(df).collect()}
    assert (got["t"]["count"], got["t"]["unique"], got["t"]["top"], got["t"]["freq"]) == (0, 0, None, None)
    assert (got["x"]["count"], got["x"]["mean"]) == (0, None)
    assert (got["y"]["count"], got["y"]["mean"], got["y"]["std"]) == (1, 1.0, None)


def test_top_of_a_tie_is_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), ("a",)], "t string")
    (row,) = profiling.text_profile(df, ["t"]).collect()
    assert (row.top, row.freq, row["unique"]) == ("a", 2, 3)


def test_text_profile_of_ties_gaps_and_single_values(spark):
    rows = [("b", "p", None, "z"), ("b", "q", None, ""), ("a", "r", None, None), ("a", "s", None, "z"),
            (None, "o", None, "")]
    df = spark.createDataFrame(rows, "two string, once string, none string, empty string")
    got = {r["column"]: tuple(r)[1:] for r in profiling.text_profile(df, df.columns).collect()}
    assert got == {
        "two": (4, 2, "a", 2), "once": (5, 5, "o", 1), "none": (0, 0, None, None),
        "empty": (4, 2, "", 2),
    }


def test_text_profile_shuffles_no_text(spark):
    df = spark.range(1000).selectExpr("cast(id % 7 as string) as t", "repeat('x', 50) as u")
    counts = profiling.text_profile(df, ["t", "u"])
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    lines = counts._jdf.queryExecution().explainString(mode).splitlines()
    moved = [lines[i + 1] for i, line in enumerate(lines) if ") Exchange" in line]
    by_digest = [line for line in moved if "digest" in line]
    assert by_digest and not any("text" in line for line in by_digest)


def test_numeric_profile_after_cleaning(spark):
    df = spark.createDataFrame([(" ",), ("10",), ("20",)], "TotalCharges string")
    row = profiling.describe_numeric(cleaning.clean_zero(df), "TotalCharges").first()
    assert (row["count"], row["mean"], row["std"], row["q50"]) == (3, 10.0, 10.0, 10.0)


def test_missing_counts_see_null_and_nan(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", float("nan")), ("b", None)], "t string, x double")
    assert sorted(values(profiling.missing_counts(df))) == [("t", 1), ("x", 2)]
    assert values(profiling.missing_wide(df, ["x"])) == [(2,)]


def test_shape_and_schema(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    assert values(profiling.shape(df)) == [(2, 2)]
    assert values(profiling.schema_listing(df)) == [(0, "n", "int", 2), (1, "t", "string", 1)]


def test_head_transposed(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "k int, t string")
    got = sorted(values(profiling.head_transposed(df, "k", 2)))
    assert got == [("k", "1", "2"), ("t", "a", "b")]


def test_incomplete_rows_are_counted_and_dropped(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 1), (None, 1), (2.0, None)], "x double, n int")
    assert values(cleaning.incomplete_rows(df, ["x", "n"])) == [(1, 3)]
    assert values(cleaning.drop_incomplete(df, ["x", "n"])) == [(1.0, 1)]


@pytest.mark.parametrize(
    "numbers, bins",
    [([0, 1, 2, 3, 3], 3), (list(range(73)), 30), ([5, 5, 5], 4), ([0.1, 0.2, 0.3, 0.7], 7),
     ([1, 8, 22, 22, 15], 21)],
)
def test_histogram_equals_numpy(spark, numbers, bins):
    df = spark.createDataFrame([(float(v),) for v in numbers], "x double")
    got = sorted(values(charts.histogram(df, "x", bins)))
    counts, edges = np.histogram(numbers, bins=np.histogram_bin_edges(numbers, bins))
    assert [r[3] for r in got] == list(counts)
    assert [r[1] for r in got] == pytest.approx(list(edges[:-1]))
    assert got[-1][2] == edges[-1]


def test_density_has_the_area_of_its_histogram(spark):
    rng = np.random.default_rng(5)
    numbers = np.round(rng.normal(30, 8, 4000))
    df = spark.createDataFrame([(float(v),) for v in numbers], "x double")
    rows = sorted(values(charts.density(df, "x")))
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert len(rows) == 200 and x[0] == numbers.min() and x[-1] == pytest.approx(numbers.max())
    width = (numbers.max() - numbers.min()) / 30
    area = float(np.sum((y[1:] + y[:-1]) / 2 * np.diff(x)))
    assert area == pytest.approx(len(numbers) * width, rel=0.02)
    h = numbers.std(ddof=1) * len(numbers) ** -0.2
    exact = np.exp(-0.5 * ((x[100] - numbers) / h) ** 2).sum() * width / (h * math.sqrt(2 * math.pi))
    assert y[100] == pytest.approx(exact, rel=1e-9)


def test_density_copies_no_values(spark):
    df = spark.range(50).selectExpr("cast(id as double) as x")
    plan = charts.density(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Aggregate")
    assert "Generate" in above and "Generate" not in below


def test_density_without_spread_is_empty(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert values(charts.density(df, "x")) == []


def test_box_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.lognormal(0, 1, 500)] + [("b", 1.0)] + [(None, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.grp: r for r in charts.box_stats(df, "g", "x").collect()}
    assert set(got) == {"a", "b"}
    x = np.array([v for g, v in rows if g == "a"])
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    a = got["a"]
    assert (a.q1, a.median, a.q3) == pytest.approx((q1, q2, q3))
    assert (a.whisker_lo, a.whisker_hi) == (inside.min(), inside.max())
    assert a.outliers == len(x) - len(inside)
    assert tuple(got["b"])[1:] == (1.0, 1.0, 1.0, 1.0, 1.0, 0)


def test_grid_and_points_keep_every_row(spark, people):
    rows = with_risk(rule_score(cleaning.clean_zero(people)))
    grid = charts.scatter_grid(rows, "tenure", "MonthlyCharges", 6.0, 10.0)
    assert grid.agg(F.sum("n")).first()[0] == people.count()
    assert charts.scatter_points(rows, "tenure", "MonthlyCharges").count() == people.count()
    some = charts.scatter_points(rows, "tenure", "MonthlyCharges", share=0.3)
    assert 0 < some.count() < people.count()


def test_rule_scores_obey_the_rule(spark, people):
    rows = with_risk(rule_score(cleaning.clean_zero(people))).collect()
    for r in rows:
        critical = r.InternetService == "Fiber optic" and r.Contract == "Month-to-month"
        assert (0.4 <= r[SCORE] < 0.9) if critical else (0.1 <= r[SCORE] < 0.4)
        assert r[FLAG] == int(r[SCORE] >= 0.5)
        assert r[BAND] == (HIGH if r[SCORE] > 0.7 else MEDIUM if r[SCORE] >= 0.5 else LOW)
    counts = {r[BAND]: r.n for r in summary.band_counts(with_risk(rule_score(people))).collect()}
    assert sum(counts.values()) == len(rows) and list(counts) == BANDS


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_reports_do_not_depend_on_partitions(spark, people, parts):
    def reports(rows):
        scored = with_risk(rule_score(cleaning.clean_zero(rows)))
        return [
            values(summary.band_summary(scored)),
            values(summary.revenue_at_risk(scored)),
            sorted(values(charts.histogram(scored, "tenure"))),
            sorted(values(charts.box_stats(scored, TARGET, "MonthlyCharges"))),
            sorted(values(cleaning.clean_median(rows, exact=True))),
            sorted(map(str, values(profiling.text_profile(rows, ["Contract", "Churn"])))),
        ]

    assert reports(people.repartition(parts)) == reports(people.coalesce(1))


def test_keep_latest(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(6)
    latest = {}
    for i, t in rows:
        latest[t] = max(i, latest.get(t, -1))
    got = values(usage.keep_latest(df, [F.col("text")], "id"), "text", "id")
    assert sorted(got) == sorted(latest.items())


def test_billing_cycles_fill_gaps_and_shift_bills(spark):
    rows = [
        (1, D(2024, 1, 4), 10.0),
        (1, D(2024, 1, 5), 20.0),
        (1, D(2024, 4, 30), 5.0),
        (2, D(2024, 2, 29), 1.0),
    ]
    df = spark.createDataFrame(rows, "o_custkey long, o_orderdate date, o_totalprice double")
    got = sorted(values(usage.billing_cycles(df, cycle_day=5)))
    assert got == [
        (1, D(2023, 12, 1), 1, 10.0),
        (1, D(2024, 1, 1), 1, 20.0),
        (1, D(2024, 2, 1), 0, 0.0),
        (1, D(2024, 3, 1), 0, 0.0),
        (1, D(2024, 4, 1), 1, 5.0),
        (2, D(2024, 2, 1), 1, 1.0),
    ]


def test_look_ahead_sees_nothing_beyond_the_cutoff(spark):
    t = datetime.datetime
    rows = [
        (1, t(2024, 1, 1), 10.0),
        (1, t(2024, 1, 20), 99.0),
        (2, t(2024, 1, 5), 7.0),
        (3, t(2024, 1, 15), 1.0),
        (2, t(2024, 3, 1), 3.0),
    ]
    df = spark.createDataFrame(rows, "o_custkey long, o_orderdate timestamp, o_totalprice double")
    cutoff = F.lit(t(2024, 1, 10))
    got = sorted(values(usage.look_ahead_labels(df, cutoff=cutoff)))
    assert got == [(1, 1, 10.0, 9, 0), (2, 1, 7.0, 5, 1)]


def test_complaint_words(spark):
    df = spark.createDataFrame([(1, "s", "en", "Slow, SLOW and broken! ok"), (2, "s", "en", "...")],
                               "doc_id long, source string, lang string, text string")
    got = sorted(values(usage.complaint_features(df)))
    assert got == [(1, "s", 5, 3, 2, 0.6), (2, "s", 0, 0, 0, None)]


def test_parse_number_agrees_with_pandas(spark):
    texts = ["1", "-2.5", "1e2", "+.5", "7.", "x", "", " 3 ", "1d", "0x1", "--1", "1e", "1e400", "-inf"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r.y for r in df.select(parse_number(F.col("x")).alias("y")).collect()]
    expected = pd.to_numeric(pd.Series(texts), errors="coerce")
    assert got == [None if pd.isna(v) else v for v in expected]


def test_histogram_leaves_out_infinite_values(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (float("inf"),), (float("nan"),)], "x double")
    assert [r.n for r in charts.histogram(df, "x", 3).collect()] == [1, 1, 1]


def test_words_of_every_language_count(spark):
    rows = [(1, "s", "es", "Qué problema, está ROTO; problema"), (2, "s", "en", "slowly slow é1"), (3, "s", "xx", "slow"), (4, "s", "en", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    got = {r.doc_id: tuple(r)[2:5] for r in usage.complaint_features(df).collect()}
    assert got == {1: (5, 3, 2), 2: (3, 1, 1), 3: (1, 0, 0), 4: (None, None, None)}
