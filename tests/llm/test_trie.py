"""The prefix trie against a brute-force one, its sketch, and its edge cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm.trie import Trie, continued, ends, nodes, prefixes, screened, sketch, turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, node_a string"


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute(rows):
    """Nodes by their whole sequence of turns."""
    said = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            key = (turn is not None, turn or 0, role or "", text or "")
            said[conv].append(key)
    own = {c: [k[2:] for k in sorted(v)] for c, v in said.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + mine[h:]
    members, ended = defaultdict(list), defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ended[tuple(path)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def subtree(node):
        out, todo = [], [node]
        while todo:
            out.append(todo.pop())
            todo += children[out[-1]]
        return out

    result = []
    for node, who in members.items():
        below = subtree(node)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(not children[n] for n in below)
        result.append(
            (min(who), len(node), parent, len(who), len(children[node]), leaves, saved,
             sha(ended[node]))
        )
    return sorted(result, key=str)


COLUMNS = (
    "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
)


def trie(df, how=Trie()):
    base = F.col("conv") - F.col("conv") % 100
    many = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return nodes(prefixes(continued(turns(df), base, many, most=6)), how)


def found(df, how=Trie()):
    return sorted((tuple(r) for r in trie(df, how).select(*COLUMNS).collect()), key=str)


def conversations(seed, n, words):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 8))):
            rows.append((c, t, "ua"[t % 2], f"é{rng.integers(0, words)}", 1, "x"))
    return rows


@pytest.mark.parametrize("words", [2, 1000])
def test_equals_brute_force(spark, words):
    rows = conversations(words, 230, words)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_small_sketch_and_pieces_change_nothing(spark):
    rows = conversations(4, 230, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, Trie(per_prefix=1, largest=1 << 15, piece=3)) == brute(rows)


def test_one_conversation_with_most_rows(spark):
    long = [(100, t, "u", f"w{t % 7}", 1, "") for t in range(240)]
    copies = [(c, t, "u", f"w{t % 7}", 1, "") for c in (200, 300) for t in range(90)]
    rows = long + copies + conversations(5, 60, 3)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edge_cases(spark):
    rows = [
        (1, None, None, None, 1, "x"), (1, 0, "", "", 1, "x"), (1, 0, "", "", 1, "x"),
        (2, 1, "b", "x" * 300_000, 1, "x"), (2, 1, "a", "z", 1, "x"), (2, 1, "a", "y", 1, "x"),
        (-7, 0, "u", "a", None, None), (-107, 0, "u", "a", None, None),
        (None, 0, "u", "lost", 1, "x"), (705, 0, "user", "one", 1, "x"),
        (17, 0, "a", "bc", 1, "x"), (23, 0, "ab", "c", 1, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == brute(rows)
    assert trie(df.limit(0)).count() == 0
    # Conversations without turns are members of the root alone.
    short = [(c, 0, "u", "own", 1, "x") for c in (101, 102, 103, 104, 105)]
    df = spark.createDataFrame(short, SCHEMA)
    assert found(df) == brute(short)
    assert any(r[1] == 0 and r[7] != sha([]) for r in found(df))


def test_the_sketch_never_calls_a_shared_prefix_single(spark):
    rows = spark.range(4000).select(
        F.lit(1).alias("depth"),
        F.xxhash64(F.col("id") % 3000).alias("node_a"),
        F.xxhash64(F.col("id") % 3000, F.lit(1)).alias("node_b"),
        F.lit(0).cast("bigint").alias("parent_a"),
        F.lit(0).cast("bigint").alias("parent_b"),
        (F.col("id") % 3000 < 1000).alias("shared"),
    )
    maps = sketch(rows)
    got = screened(rows, maps).groupBy("shared").agg(F.avg(F.col("single").cast("int"))).collect()
    share = {r[0]: r[1] for r in got}
    assert share[True] == 0.0 and share[False] > 0.95


def test_ends_in_many_pieces(spark):
    rows = spark.range(1000).select(
        (F.col("id") % 2).alias("node_a"), F.lit(5).cast("bigint").alias("node_b"),
        ((F.col("id") - 500) * 7).alias("conv"),
    )
    got = {r.node_a: r.ends_sha256 for r in ends(rows, Trie(piece=13)).collect()}
    assert got == {k: sha([(i - 500) * 7 for i in range(1000) if i % 2 == k]) for k in (0, 1)}
