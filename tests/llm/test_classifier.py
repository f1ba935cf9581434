"""Subword embeddings: features by brute force, held-out accuracy, edge cases."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import MEDIUM

from holdfast.llm import embedder
from holdfast.llm.classifier import scored, trained
from holdfast.llm.embedder import Embedder, counted, learned
from holdfast.llm.queries import op11_quality_classifier
from holdfast.llm.sampling import bound, picked

TEXTS = ["ab ab ab ab", "", None, "é\nzz  top", " the end ", "ab ab ab ab"]


def number_of_features(text: str | None, shapes) -> int:
    text = text or ""
    words = text.split()
    total = len(words) + max(len(words) - 1, 0) + text.count("\n") + 1
    triples = list(zip(words, words[1:], words[2:]))
    total += len(triples) - len(set(triples))
    for word in words:
        marked = f" {word} "
        for n in shapes:
            total += max(len(marked) - n + 1, 0)
    return total


def test_number_of_features(monkeypatch):
    how = Embedder()
    want = [number_of_features(t, how.shapes) for t in TEXTS]
    assert [int(c.sum()) for _, c in counted(pa.array(TEXTS), how)] == want
    # In pieces that cut words, nothing is lost or counted twice.
    monkeypatch.setattr(embedder, "PIECE", 5)
    assert [int(c.sum()) for _, c in counted(pa.array(TEXTS), how)] == want


def test_features_do_not_depend_on_neighbours():
    how = Embedder()
    together = counted(pa.array(TEXTS), how)
    for text, (bucket, count) in zip(TEXTS, together):
        ((alone, number),) = counted(pa.array([text], pa.string()), how)
        assert bucket.tolist() == alone.tolist() and count.tolist() == number.tolist()


def test_scores_are_the_softmax_of_the_average():
    how = Embedder(buckets=1 << 8, updates=2000)
    texts = pa.array(["good prose here", "BAD!! BAD!!", "more good prose", "VERY!! BAD!!"])
    rows = [(b, c, y) for (b, c), y in zip(counted(texts, how), (1, 0, 1, 0))]
    weights = learned(rows, how)
    got = embedder.scores(texts, weights, how)
    for (bucket, count, _), p in zip(rows, got):
        logit = (count * weights.logit[bucket]).sum() / count.sum() + weights.offset
        assert p == pytest.approx(1 / (1 + np.exp(-logit)))
    assert ((got >= 0.5) == [True, False, True, False]).all()


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op11_quality_classifier(spark, MEDIUM).collect()}
    assert len(got) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()
    mine = [(got[r.doc_id].score, r.quality) for r in labels if got[r.doc_id].held_out]
    right = [(s >= 0.5) == (q == 1) for s, q in mine]
    assert np.mean(right) >= 0.95
    pairs = [(a > b) + (a == b) / 2 for a, x in mine for b, y in mine if x > y]
    assert np.mean(pairs) >= 0.97


def test_labels_of_held_out_rows_do_not_count(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").selectExpr("doc_id", "quality")
    some = "crc32(cast(cast(id as string) as binary)) % 3 != 1"
    turned = labels.selectExpr(
        "doc_id",
        "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) quality",
    )
    how = Embedder(updates=300)
    from pyspark.sql import functions as F

    a = trained(docs, labels, F.expr(some), how=how)
    b = trained(docs.repartition(7), turned, F.expr(some), how=how)
    assert (a.logit == b.logit).all() and a.offset == b.offset


def test_edge_cases(spark):
    fields = "doc_id bigint, text string, score double, id int, good string"
    rows = [(1, "fine words " * 3, 0.0, 1, "x"), (1, "fine words " * 3, 0.0, 1, "x")]
    rows += [(None, None, None, None, None), (2, "", 0.0, 2, ""), (3, "BAD " * 200_000, 0.0, 3, "")]
    docs = spark.createDataFrame(rows, fields)
    labels = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 0), (3, 0), (None, 1), (2, None), (99, 1)], "doc_id int, quality int"
    )
    how = Embedder(updates=200)
    got = scored(docs, trained(docs, labels, how=how), how=how).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 3]
    by = {r.doc_id: r.score for r in got}
    assert by[1] > 0.5 > by[3] and by[None] == by[2]
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    nothing = trained(docs, labels.limit(0), how=how)
    assert {r.score for r in scored(docs, nothing, how=how).collect()} == {0.5}
    assert scored(docs.limit(0), trained(docs.limit(0), labels, how=how), how=how).count() == 0
    one = trained(docs, labels.where("quality = 0"), how=how)
    assert all(r.score < 0.5 for r in scored(docs, one, how=how).collect())


def test_samples_stay_whole_at_any_size(spark):
    assert bound(4000, 3000) == (1 << 63)
    for n in (10**5, 10**9, 10**11, 10**14):
        share = (bound(4000, n) + (1 << 63)) / (1 << 64)
        assert share * n == pytest.approx(4000, rel=1e-4)
    table = spark.range(20_000)
    assert 850 < picked(table, 1000, "id").count() < 1150
    assert picked(table, 30_000, "id").count() == 20_000
    assert Counter(r.id for r in picked(table, 1000, "id").collect()) == Counter(
        r.id for r in picked(table.repartition(3), 1000, "id").collect()
    )
