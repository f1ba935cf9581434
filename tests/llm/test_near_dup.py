"""Near duplicates against brute force, and the signatures' promise."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import MEDIUM

from holdfast.llm.near_dup import NearDup, dart_minhash, near_duplicates, one_of_each


def shingled(text, weight="count"):
    """Shingles of a text; one that occurs n times stands for n elements under "count"."""
    words = (text or "").split()
    if not words:
        return set()
    size = min(5, len(words))
    often = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return {(g, k) for g, n in often.items() for k in range(n if weight == "count" else 1)}


def brute_classes(rows, t=0.8, weight="count"):
    sets = [shingled(text, weight) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for a, b in {(a, b) for at in where.values() for a in at for b in at if a < b}:
        both = len(sets[a] & sets[b])
        if both >= t * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[find(i)].append(key)
    return sorted(sorted(g) for g in groups.values())


def classes(df):
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.class_id].append(r.doc_id)
    return sorted(sorted(g) for g in groups.values())


def edited(words, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words)


def family(n, size=120):
    """Copies with ever more edits: some linked to the original, some to each other, some alone."""
    rng = random.Random(5)
    base = [f"b{rng.randrange(5000)}" for _ in range(size)]
    return [" ".join(base)] + [edited(base, 0.002 * (k % 40), k) for k in range(1, n)]


def test_a_large_family_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(family(160))]
    rows += [(1000 + i, " ".join(f"x{i}_{k}" for k in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_classes(rows)
    assert classes(near_duplicates(df)) == want
    # Frequent elements in many slices.
    assert classes(near_duplicates(df, how=NearDup(slice=4))) == want


@pytest.mark.parametrize("weight", ["count", "set"])
def test_documents_equal_brute_force(spark, weight):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = classes(near_duplicates(docs, how=NearDup(weight=weight)))
    assert got == brute_classes(rows, weight=weight)


def test_repeated_passages_equal_brute_force(spark):
    # Texts of one passage many times over, with edits: plain sets would take them for one.
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(25)]
    rows = []
    for i in range(80):
        words = passage * (1 + i % 6) + [f"q{i % 9}_{k}" for k in range(rng.randrange(30))]
        rows.append((i, edited(words, 0.004 * (i % 5), i)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert classes(near_duplicates(df)) == brute_classes(rows)
    assert brute_classes(rows) != brute_classes(rows, weight="set")


def test_edge_cases(spark):
    text = "one two three four five six seven eight"
    rows = [(1, None, 7), (2, "", 7), (3, " \n", 7), (4, text, 7), (4, text, 7), (9, text, 7)]
    rows += [(5, "a b", 7), (6, "a b", 7), (None, "lonely words here", 7), (8, "word " * 30000, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node bigint")
    got = sorted((r.doc_id or 0, r.class_id, r.class_size) for r in near_duplicates(df).collect())
    assert got == [
        (0, None, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 3), (4, 4, 3), (5, 5, 2),
        (6, 5, 2), (8, 8, 1), (9, 4, 3),
    ]
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8]
    assert near_duplicates(df.limit(0)).count() == 0 and one_of_each(df.limit(0)).count() == 0


def test_null_and_clashing_ids_keep_classes_apart(spark):
    def plain(name):
        return " ".join(f"{name}{k}" for k in range(60))

    rows = [(None, plain("a")), (None, plain("b")), (7, plain("c")), (7, plain("d"))]
    rows += [(None, plain("e")), (None, plain("e") + " more"), (9, plain("f")), (None, plain("f") + " more")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.class_size, r.n_links) for r in got) == [
        (0, 0, 1, 0), (0, 0, 1, 0), (0, 0, 2, 1), (0, 0, 2, 1), (0, 9, 2, 1),
        (7, 7, 1, 0), (7, 7, 1, 0), (9, 9, 2, 1),
    ]
    kept = [tuple(r) for r in one_of_each(df).collect()]
    assert len(kept) == 6 and set(rows[:4]) | {rows[6]} <= set(kept)
    assert len(set(kept) & set(rows[4:6])) == 1


def test_counting_repeats_tells_texts_apart(spark):
    line = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, line), (2, f"{line} {line} {line}")], "doc_id bigint, text string")
    assert len(classes(near_duplicates(df, how=NearDup(weight="count")))) == 2
    assert len(classes(near_duplicates(df, how=NearDup(weight="set")))) == 1


def test_copies_of_one_text_with_and_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(None, text, 1)] * 40 + [(i, text, 2) for i in range(3, 40)] + [(99, text + " end", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, of int").repartition(5)
    got = near_duplicates(df).collect()
    assert {(r.class_id, r.class_size) for r in got} == {(3, 78)} and len(got) == 78
    kept = one_of_each(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(3, text, 2)]


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_agree_as_often_as_the_sets_are_similar(weighted):
    rng = np.random.default_rng(3)
    elements = rng.integers(1, 2**62, 300).astype(np.uint64)
    wa = rng.uniform(0.2, 4, 300) if weighted else np.ones(300)
    wb = wa * np.where(np.arange(300) < 60, 0 if not weighted else 0.3, 1)
    keep = wb > 0
    flat = np.concatenate([elements, elements[keep]])
    weights = np.concatenate([wa, wb[keep]])
    bounds = np.array([0, 300, 300 + keep.sum()])
    a, b = dart_minhash(flat, weights, bounds, 4000)
    expected = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert (a == b).mean() == pytest.approx(expected, abs=0.03)


def test_empty_sets_have_zero_signatures():
    got = dart_minhash(np.zeros(0, np.uint64), np.zeros(0), np.array([0, 0]), 8)
    assert got.tolist() == [[0] * 8]
