"""Scans, sinks, written tables and daily layers."""

from pathlib import Path

import pytest
from conftest import MEDIUM, values
from pyspark.sql import functions as F

from holdfast.plans.daily import LAYERS, run_day
from holdfast.schema import SCORE, SUBSCRIBER
from holdfast.session import cut_lineage, fresh_dir, shared_root, written_tables
from holdfast.sources.readers import read_csv, read_csv_tokens
from holdfast.sources.sinks import read_day, write_csv, write_day, write_result
from holdfast.sources.subscribers import order_history, subscribers


def test_shared_folder_is_the_one_the_session_names(spark, people):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark) == named
    kept = cut_lineage(people)
    assert all(named in f for f in kept.inputFiles())
    assert sorted(values(kept)) == sorted(values(people))


def test_csv_round_trip_declared_and_inferred(spark, people):
    path = write_csv(people, fresh_dir(spark, "csv"))
    declared = read_csv(spark, path)
    assert declared.schema == SUBSCRIBER
    assert sorted(map(str, values(declared))) == sorted(map(str, values(people)))
    kinds = dict(read_csv(spark, path, schema=None).dtypes)
    assert kinds["TotalCharges"] == "string" and kinds["MonthlyCharges"] == "double"
    assert kinds["tenure"] == "int"


def test_columns_are_taken_by_name(spark, people):
    rows = people.select("Churn", "tenure", F.lit("x").alias("extra"), *people.columns[:17], "MonthlyCharges", "TotalCharges")
    got = read_csv(spark, write_csv(rows, fresh_dir(spark, "csv")))
    assert got.columns == people.columns
    assert sorted(map(str, values(got))) == sorted(map(str, values(people)))


def test_a_missing_column_is_an_error(spark, people):
    path = write_csv(people.drop("tenure"), fresh_dir(spark, "csv"))
    with pytest.raises(ValueError, match="tenure"):
        read_csv(spark, path)


def test_text_survives_as_it_is(spark):
    texts = ['Say "e", check', "two\nlines", "", None, " blank ", ",", '"', "a\\b", "\\"]
    df = spark.createDataFrame(list(enumerate(texts)), "customerID int, gender string")
    path = write_csv(df.repartition(1), fresh_dir(spark, "csv"))
    got = read_csv(spark, path, df.schema, multi_line=True)
    assert sorted(values(got)) == list(enumerate(texts))
    tokens = read_csv_tokens(spark, path, df.schema)
    assert sorted(values(tokens)) == [(i, t or None) for i, t in enumerate(texts)]


def test_written_tables_go_with_their_scope(spark, people):
    with written_tables(spark) as folder:
        kept = cut_lineage(people.limit(5))
        assert kept.count() == 5 and all(folder in f for f in kept.inputFiles())
        assert Path(folder).exists()
    assert not Path(folder).exists()
    assert folder not in fresh_dir(spark, "x")


def test_the_last_order_needs_no_sort(spark):
    plan = subscribers(spark, MEDIUM).select("Contract", "PaymentMethod")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_missing_tokens(spark):
    path = fresh_dir(spark, "csv")
    Path(path).mkdir()
    lines = ["customerID,gender,tenure,MonthlyCharges,TotalCharges",
             "1,NA,null,1.5, ", "2,None,3,NaN,n/a", "3,Male,x,2,7"]
    Path(path, "a.csv").write_text("\n".join(lines) + "\n")
    from pyspark.sql import types as T

    schema = T.StructType([SUBSCRIBER[c] for c in lines[0].split(",")])
    assert sorted(values(read_csv_tokens(spark, path, schema))) == [
        ("1", None, None, 1.5, " "),
        ("2", None, 3, None, None),
        ("3", "Male", None, 2.0, "7"),
    ]


def test_results_replace_earlier_ones(spark):
    path = fresh_dir(spark, "result")
    write_result(spark.range(5), path)
    write_result(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_one_day_is_replaced_alone(spark):
    path = fresh_dir(spark, "layer")
    write_day(spark.range(5), path, "2024-01-01")
    write_day(spark.range(7), path, "2024-01-02")
    write_day(spark.range(2), path, "2024-01-01")
    assert read_day(spark, path, "2024-01-01").count() == 2
    assert read_day(spark, path, "2024-01-02").count() == 7
    plan = read_day(spark, path, "2024-01-02")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_daily_run_can_be_repeated(spark, people):
    root = fresh_dir(spark, "layers")
    first = run_day(spark, people, root, "2024-05-01")
    before = sorted(map(str, values(read_day(spark, first["scored"], "2024-05-01"))))
    run_day(spark, people.limit(10), root, "2024-05-02")
    again = run_day(spark, people, root, "2024-05-01")
    assert set(again) == set(LAYERS)
    assert sorted(map(str, values(read_day(spark, again["scored"], "2024-05-01")))) == before
    assert read_day(spark, again["scored"], "2024-05-02").where(F.col(SCORE).isNull()).count() == 0


def test_scans_read_only_what_a_report_needs(spark):
    plan = subscribers(spark, MEDIUM).select("Contract")._jdf.queryExecution().toString()
    assert "c_name" not in plan.split("Physical Plan")[1]
    assert "o_totalprice" not in plan.split("Physical Plan")[1]
    count = subscribers(spark, MEDIUM).groupBy().count()._jdf.queryExecution().toString()
    assert "orders.parquet" not in count.split("Physical Plan")[1]


def test_last_order_before_1970(spark):
    rows = [(1, 5, "1965-02-01", 3.0, "O", "5-LOW"), (1, 6, "1964-02-01", 3.0, "F", "1-URGENT"),
            (2, 7, "1970-01-01", 1.0, "P", "2-HIGH"), (2, 8, "1969-12-31", 1.0, "F", "5-LOW")]
    orders = spark.createDataFrame(
        rows,
        "o_custkey bigint, o_orderkey bigint, o_orderdate string, o_totalprice double,"
        " o_orderstatus string, o_orderpriority string",
    ).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    got = order_history(orders).select("o_custkey", "last_status", "last_priority")
    assert sorted(values(got)) == [(1, "O", "5-LOW"), (2, "P", "2-HIGH")]
