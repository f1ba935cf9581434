"""Hand-made rows for every place where missing values, text and rounding can go wrong."""

import math

import pytest
from conftest import values
from pyspark.sql import functions as F

from holdfast.functions.hashing import hash_between, hash_uniform
from holdfast.functions.numbers import (
    fill,
    money_sum,
    money_text,
    parse_number,
    round_even,
    to_double,
)
from holdfast.functions.risk import both_equal, clip, flag, risk_band
from holdfast.schema import HIGH, LOW, MEDIUM

NAN = float("nan")


def column(spark, rows, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, x {kind}")


def apply(spark, rows, kind, expression):
    df = column(spark, rows, kind).select("i", expression(F.col("x")).alias("y"))
    return [r.y for r in sorted(df.collect(), key=lambda r: r.i)]


def test_text_to_number_accepts_plain_numbers_only(spark):
    rows = [" ", "29.85", "1889.5", None, "1.0d", "0x10", " 12.5 ", "NaN", "1e3", ".5", "5.", "+5",
            "1,000", "1_000", "", "1 2", "1e400", "-Infinity", "inf", "info"]
    expected = [None, 29.85, 1889.5, None, None, None, 12.5, None, 1000.0, 0.5, 5.0, 5.0,
                None, None, None, None, None, -math.inf, math.inf, None]
    assert apply(spark, rows, "string", parse_number) == expected


def test_cast_to_double_gives_null_instead_of_an_error(spark):
    got = apply(spark, [" ", "29.85", "1.0d", "0x10"], "string", to_double)
    assert got == [None, 29.85, 1.0, None]


def test_fill_covers_null_and_nan(spark):
    assert apply(spark, [NAN, None, 2.0], "double", lambda c: fill(c, F.lit(-1.0))) == [-1, -1, 2]


def test_bands_at_their_edges(spark):
    rows = [NAN, None, 0.7, 0.7000001, 0.5, 0.49]
    assert apply(spark, rows, "double", risk_band) == [LOW, LOW, MEDIUM, HIGH, MEDIUM, LOW]


def test_clip_invents_no_scores(spark):
    assert apply(spark, [None, NAN, -0.1, 1.2, 0.3], "double", clip) == [None, None, 0.0, 1.0, 0.3]


def test_threshold_strictness_and_missing(spark):
    rows = [0.5, 0.51, 0.49, NAN, None]
    assert apply(spark, rows, "double", flag) == [1, 1, 0, 0, 0]
    assert apply(spark, rows, "double", lambda c: flag(c, strict=True)) == [0, 1, 0, 0, 0]


def test_halves_go_to_the_even_neighbour(spark):
    rows = [0.25, 0.35, 2.45]
    assert apply(spark, rows, "double", lambda c: round_even(c, 1)) == [0.2, 0.4, 2.4]


def test_money_text(spark):
    got = apply(spark, [2.675, 0.125, -1234.5, None], "double", money_text)
    assert got == ["$2.67", "$0.12", "$-1,234.50", None]


def test_money_adds_up_exactly(spark):
    df = column(spark, [0.1] * 10 + [0.2], "double")
    assert values(df.agg(money_sum(F.col("x")))) == [(1.2,)]
    small = column(spark, [0.004] * 1000 + [NAN, None], "double")
    assert values(small.agg(money_sum(F.col("x")))) == [(4.0,)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_money_never_wraps(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = column(spark, [9e16, 9e16, NAN], "double")
        assert values(df.agg(money_sum(F.col("x")))) == [(1.8e17,)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_infinite_amounts_are_not_left_out(spark):
    inf = math.inf
    for rows, total in (([inf, 1.0], inf), ([-inf, 2.0, NAN, None], -inf), ([1.5, NAN], 1.5)):
        assert values(column(spark, rows, "double").agg(money_sum(F.col("x")))) == [(total,)]
    both = column(spark, [inf, -inf], "double").agg(money_sum(F.col("x")))
    assert math.isnan(values(both)[0][0])


def test_mask_has_no_nulls(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), (None, "c")], "p string, q string")
    got = df.select(both_equal(F.col("p"), "a", F.col("q"), "b").alias("m"))
    assert [r.m for r in got.collect()] == [True, False, False]


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_draws_do_not_depend_on_partitions(spark, parts):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    draw = hash_uniform("key", "s").alias("u")
    one = sorted(values(ids.coalesce(1).select("key", draw)))
    assert sorted(values(ids.repartition(parts).select("key", draw))) == one
    assert all(0 <= u < 1 for _, u in one)
    assert abs(sum(u for _, u in one) / 1000 - 0.5) < 0.05


def test_draws_stay_in_range_and_differ_by_salt(spark):
    df = spark.range(500).select(
        hash_between("id", "a", 0.1, 0.4).alias("a"), hash_between("id", "b", 0.1, 0.4).alias("b")
    )
    rows = values(df)
    assert all(0.1 <= a < 0.4 and 0.1 <= b < 0.4 for a, b in rows)
    assert sum(a == b for a, b in rows) < 5


def test_missing_key_has_no_draw(spark):
    got = column(spark, [None], "string").select(hash_uniform("x", "s").alias("u"))
    assert values(got) == [(None,)]
