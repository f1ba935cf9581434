"""The Bloom filter holds all it was given, and little else while it may grow."""

import numpy as np
import pytest

from holdfast.llm import bloom


def hashes(spark, first, n):
    df = spark.range(first, first + n).selectExpr("xxhash64(id) as hash")
    return df, df.toPandas()["hash"].to_numpy(np.int64).view(np.uint64)


@pytest.mark.parametrize("part", [1 << 20, 1000])
def test_holds_its_own_and_few_others(spark, monkeypatch, part):
    monkeypatch.setattr(bloom, "PART", part)
    df, own = hashes(spark, 0, 20_000)
    built = bloom.bloom_filter(df.union(df).selectExpr("hash"), "hash", 20_000, 1 << 20)
    _, other = hashes(spark, 100_000, 50_000)
    assert len(built.rows) == -(-20_000 // part) and built.rows.nbytes < 2.1 * 20_000
    assert built.holds(own).all() and built.holds(other).mean() < 0.003


def test_small_filters_lose_nothing(spark):
    df, own = hashes(spark, 0, 5000)
    built = bloom.bloom_filter(df, "hash", 5000, 1000)
    assert built.rows.nbytes <= 1000 and built.holds(own).all()
    assert bloom.bloom_filter(df, "hash", 5000, 0).holds(own).all()


def test_empty_and_missing(spark):
    df = spark.createDataFrame([(None,)], "hash bigint")
    built = bloom.bloom_filter(df, "hash", 0, 1 << 20)
    assert not built.holds(np.arange(100, dtype=np.uint64)).any()
    assert built.holds(np.zeros(0, np.uint64)).shape == (0,)
