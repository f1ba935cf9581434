"""The language model against a plain one over the same tokens."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</s>"]


def rows(n=200):
    rng = np.random.default_rng(2)
    every = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(n):
        w = [int(rng.integers(40))]
        for _ in range(int(rng.integers(0, 30))):
            w.append((w[-1] + 1) % 40 if rng.random() < 0.7 else int(rng.integers(40)))
        texts.append(" ".join(every[k].upper() if k % 7 == 0 else every[k] for k in w))
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, "É unseen")]


@pytest.mark.parametrize(
    "how",
    [
        lm.Model(),
        lm.Model(block=50, range_tokens=100),
        lm.Model(block=50, range_tokens=100, fan=20),
        lm.Model(block=50, range_tokens=1000, fan=20),
    ],
)
def test_scores_equal_a_plain_model(spark, monkeypatch, how):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    weights = np.tile([0.6, 0.3, 0.1], (lm.BUCKETS, 1))
    monkeypatch.setattr(lm, "mixture_weights", lambda *a: weights)
    got = {r.doc_id: r for r in lm.scores(df, F.col("doc_id") % 5 == 1, how=how).collect()}
    assert len(got) == len(data)
    one, two, before = Counter(), Counter(), Counter()
    for i, t in data:
        if i % 5 != 1:
            w = ["<s>", *tokens(t)]
            one.update(w[1:])
            two.update(zip(w, w[1:]))
            before.update(w[:-1])
    total, types = sum(one.values()), len(one)
    for i, t in data:
        w = ["<s>", *tokens(t)]
        base = sum(math.log10((one[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w[1:])
        score = 0.0
        for u, x in zip(w, w[1:]):
            p = 0.6 * (two[u, x] / before[u] if before[u] else 0)
            score += math.log10(p + 0.3 * one[x] / total + 0.1 / (types + 1))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (i % 5 == 1, len(w) - 1, total)
        assert r.n_known == sum(one[x] > 0 for x in w[1:])
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_held_out_texts_are_likelier_than_under_single_words(spark):
    df = spark.createDataFrame(rows(600), "doc_id bigint, text string")
    out = lm.scores(df, F.col("doc_id") % 5 == 1).where("held_out")
    sums = out.agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > 0.8 * sums[1]


def test_weights_find_the_mixture_that_made_the_events():
    # Events whose pair share is worth much more than the others.
    cell = np.array([(3 * lm.BINS + 140) * lm.BINS + 130, (3 * lm.BINS + 0) * lm.BINS + 140])
    weights = lm.mixture_weights(cell, np.array([900, 100]), 500)
    assert weights[3, 0] > 0.7 and weights[3].sum() == pytest.approx(1)
    assert weights[5] == pytest.approx(lm.mixture_weights(cell, np.array([900, 100]), 500)[6])
    assert lm.mixture_weights(cell[:0], cell[:0], 5)[0] == pytest.approx([1 / 3] * 3)


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, "a b", 1), (1, "a b", 1), (2, "c " * 60000, 1)], "doc_id bigint, text string, block int")
    got = lm.scores(df, F.col("doc_id") == 2).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.train_tokens) for r in got) == [
        (0, False, 3, 9), (1, False, 3, 9), (1, False, 3, 9), (2, True, 60001, 9),
    ]
    assert lm.scores(df.limit(0), F.lit(False)).count() == 0
    nothing = lm.scores(df, F.lit(True)).collect()
    assert {r.train_tokens for r in nothing} == {0} and all(r.base_score == 0 for r in nothing)
