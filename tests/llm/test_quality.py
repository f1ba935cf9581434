"""Statistics against plain Python, the base rules, and learned lists."""

import re
from collections import Counter

from conftest import MEDIUM
from pyspark.sql import functions as F

from holdfast.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_equal_plain_python(spark):
    texts = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h " * 3, "x\nx\n\nx y\n"]
    texts += ["w " * 20000, "é ü\x0bß # *|", "a a a a a a a a a", "p q r s t u v w x p q r s t u v w"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, n_words int")
    rows = Q.statistics(df).select("row.doc_id", *BASE).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == {i: expected(t) for i, t in enumerate(texts)}


def test_documents_equal_plain_python(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    for r in Q.statistics(docs).select("row.text", *BASE).collect():
        assert tuple(r[1:]) == expected(r[0])


def test_a_list_learns_two_kinds_of_bad_rows_in_order(spark):
    rows = spark.range(3000).select(
        *(F.lit(0.5).alias(c) for c in Q.STATISTICS if c not in ("mean_word", "mark_share")),
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 10).alias("mean_word"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 100).alias("mark_share"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) == 0).alias("aside"),
    )
    rows = rows.withColumn("bad", (F.col("mean_word") > 8.5) | (F.col("mark_share") > 0.85))
    rules = Q.learn(rows)
    assert {t.column for rule in rules for t in rule} == {"mean_word", "mark_share"}
    judged = rows.withColumn("kept", Q.verdict(rules))
    wrong = judged.where(F.col("kept") == F.col("bad")).count()
    assert wrong < 0.06 * 3000


def test_without_labels_only_base_rules_count(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "a b c d e f g h " * 9), (1, text)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = Q.quality(docs, labels).select("row.doc_id", "base_failed", "kept").collect()
    assert sorted(map(tuple, got)) == [(1, False, True), (1, False, True), (2, True, False), (3, True, False), (4, True, False)]
    assert Q.quality(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    judged = Q.quality(docs, labels).where("not base_failed").select("row.doc_id", "kept")
    right = judged.join(labels, "doc_id").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")))
    assert right.first()[0] > 0.95
