"""Targets against plain water filling, and the mix itself."""

import pytest
from pyspark.sql import functions as F

from holdfast.llm.mixing import Mixing, mixed_sizes, mixture, targets


def plain(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        want = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if want[s] > most * sizes[s]}
        if not over:
            return {s: want.get(s, most * sizes[s]) for s in names}
        capped |= over


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 1, "b": 1000, "c": 10, "d": 5000, None: 3, "é": 40, "Z": 7},
        {"a": 0, "b": 10, None: 0},
        {"only": 12},
        {f"s{k:03}": (k * 37) % 101 + 1 for k in range(90)},
    ],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(plain(sizes))


def test_the_mix_takes_what_the_sizes_say(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 4}", 1.5, "x", 9) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, rate double, copy string, row int")
    sizes = mixed_sizes(df)
    by = sizes.groupBy(F.col("doc_id") % 4).agg(
        F.max("target").alias("target"), F.sum("taken").alias("taken")
    ).collect()
    assert all(r.taken == pytest.approx(r.target, rel=0.25) for r in by)
    assert sizes.where("taken > 3 * size").count() == 0
    mix = mixture(df)
    assert mix.columns == [*df.columns, "copy_"]
    taken = {r.doc_id: r.copies for r in sizes.collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == taken
    assert sorted(map(tuple, mixture(df).collect())) == sorted(map(tuple, mix.collect()))


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y", None), (3, "x y", None), (None, "z", "b"), (4, "w " * 40000, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixed_sizes(df, how=Mixing(weights=(1,)))
    assert sorted((r.doc_id or 0, r["size"], r.source_size) for r in got.collect()) == [
        (0, 1, 40001), (1, 0, 0), (2, 0, 4), (3, 2, 4), (3, 2, 4), (4, 40000, 40001),
    ]
    assert mixed_sizes(df.limit(0)).count() == 0 and mixture(df.limit(0)).count() == 0


def test_rows_without_ids_draw_apart(spark):
    """Targets are met when ids are missing or shared."""
    for ids in (None, 7):
        rows = [(ids, f"{i} " + "w " * 7, "a" if i % 2 else "b") for i in range(4000)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        sizes = mixed_sizes(df, how=Mixing(weights=(3, 1)))
        for r in sizes.groupBy("target").agg(F.sum("taken").alias("taken")).collect():
            assert r.taken == pytest.approx(r.target, rel=0.05)
