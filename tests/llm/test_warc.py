"""Archives: round trips, records cut into pieces, merging, damage."""

import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


PAYLOADS = ["", None, "a\r\n", "\r\n\r\n", "x\r\n\r\nWARC/1.1\r\n\r\n", "\r", "\n\r\n\r", "é" * 50, "same", "same", "\r\n\r\r\n\r\n"]


def test_round_trip(spark):
    rows = [(k, f"http://h{k % 3}.example.com/{k}", p) for k, p in enumerate(PAYLOADS)]
    got = {r.id: r for r in warc.archived(table(spark, rows).repartition(2)).collect()}
    assert len(got) == len(rows)
    chief = {}
    for k, _, p in rows:
        chief[p or ""] = k
    for k, url, p in rows:
        r = got[k]
        assert (r.url, r.size, r.digest) == (url, len((p or "").encode()), digest(p))
        expected = ("response", None) if chief[p or ""] == k else ("revisit", chief[p or ""])
        assert (r.type, r.refers_to) == expected


def test_large_pages_and_edge_cases(spark):
    rows = [(None, None, "x"), (1, "no scheme", "x"), (2, "http://a.b/\r\nc", "long " * 100000), (2, "http://a.b/", "long " * 100000)]
    df = table(spark, rows)
    got = sorted((r.id or 0, r.type, r.refers_to, r.size) for r in warc.archived(df).collect())
    assert got == [(0, "revisit", 1, 1), (1, "response", None, 1), (2, "response", None, 500000), (2, "response", None, 500000)]
    assert warc.archived(df.limit(0)).count() == 0
    some = warc.archived(df, how=warc.Archive(least=10)).collect()
    assert sorted(r.type for r in some) == ["response"] * 4


def test_the_index_is_in_order_over_all_ranges(spark):
    rng = random.Random(1)
    rows = [(k, f"http://www.h{rng.randrange(4)}.example.com/p", f"{k}") for k in range(3000)]
    entries = warc.archived(table(spark, rows).repartition(5), how=warc.Archive(entries=400))
    assert entries.rdd.getNumPartitions() > 3
    keys = [(r.key, r.time, r.id) for r in entries.collect()]
    assert len(keys) == 3000 and keys == sorted(keys)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree_merges(runs):
    tagged = [[(x, r, i) for i, x in enumerate(sorted(run))] for r, run in enumerate(runs)]
    merged = list(warc.LoserTree([iter(run) for run in tagged]))
    assert merged == sorted(x for run in tagged for x in run)


def test_url_key(spark):
    df = spark.createDataFrame([("HTTP://Www.A.com/B?q=1#f",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in df.select(warc.url_key(df.u)).collect()] == ["com,a,www)/b?q=1#f", "nothing)", ")"]


def test_damage_is_found():
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "WARC-Date": "d", "WARC-Payload-Digest": "sha1:" + digest("other")}
    record = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"
    with pytest.raises(ValueError):
        warc._entry("f", 0, record, head)
