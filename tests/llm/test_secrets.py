"""Patterns against plain regular expressions, the network on held-out findings, redaction."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import MEDIUM
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from holdfast.llm import charnet
from holdfast.llm import secrets as S
from holdfast.llm.sampling import picked

ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.A,
)


def base(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(spans, key=lambda x: (x[1], order[x[0]]))


@pytest.fixture(scope="module")
def net():
    rows, labels = S._generated(S.Secrets(made=600))
    order = np.random.default_rng(0).permutation(len(rows))
    rows, labels = rows[order], labels[order].astype(float)
    aside = np.arange(len(rows)) % 3 == 0
    trained = charnet.train(rows[~aside], labels[~aside], 1)
    return charnet.calibrate(trained, rows[aside], labels[aside], 0.98)


PARTS = st.sampled_from(
    ["token", "Api_Key", "apikey", " = ", ":", '"', "AKIA", "ABCDEF0123456789", "deadbeef", "é",
     "x", " ", "0123456789abcdef", "\n", "PassWD", "=", "K", "ſecret"]
)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=5))
def test_patterns_equal_plain_expressions(texts):
    data, offsets, found, *_ = S.scan(pa.array(texts, pa.string()))
    points = S._points(data)
    for i, text in enumerate(texts):
        got = [
            (S.KINDS[k], int(points[s] - points[offsets[i]]), int(points[e] - points[offsets[i]]))
            for s, k, e in found.get(i, ())
        ]
        assert got == base(text)


def test_documents(spark, net):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in S.secrets(docs, net).collect():
        spans = base(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(x[0] == k for x in spans) for k in S.KINDS[:3]
        )
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r.spans.split(",")) | {""}


def test_network_on_other_findings(net):
    rows, labels = S._generated(S.Secrets(made=300, seed=77))
    said = charnet.probability(net, rows) >= net.threshold
    assert said[labels == 1].mean() > 0.93
    assert said[labels == 0].mean() < 0.05


def test_gradients_are_those_of_the_loss():
    rows, labels = S._generated(S.Secrets(made=20))
    net = charnet.fresh(3)

    def loss():
        z = charnet.logits(net, rows)
        return np.mean(np.log1p(np.exp(-z)) * labels + np.log1p(np.exp(z)) * (1 - labels))

    for w, g in zip(net.weights(), charnet._gradients(net, rows, labels)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-3)


def test_redaction_and_edge_cases(spark, net):
    key = "0123456789abcdef0123"
    rows = [(1, None, 5, 1), (2, "", 5, 1), (3, f"é token = '{key}' x", 5, 1), (3, f"é token = '{key}' x", 5, 1)]
    rows += [(None, "plain", 5, 1), (4, "word " * 30000 + key, 5, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, id int")
    clean = S.redact(df, net, length_column="n_chars")
    assert clean.columns == df.columns
    got = sorted((r.doc_id or 0, r.text, r.n_chars) for r in clean.collect() if r.doc_id != 1)
    assert got[0] == (0, "plain", 5)
    assert got[1:4] == [(2, "", 5), (3, "é [SECRET]' x", 13), (3, "é [SECRET]' x", 13)]
    assert got[4][1].endswith("word [SECRET]") and got[4][2] == 150008
    counts = S.secrets(df, net).collect()
    assert sorted((r.doc_id or 0, r.n_hex) for r in counts) == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 1), (4, 1)]
    assert S.secrets(df.limit(0), net).count() == 0 and S.redact(df.limit(0), net).count() == 0
    S.trained(df.limit(0), how=S.Secrets(made=30))


def reported(net, texts):
    data, offsets, spans = S.findings(pa.array(texts, pa.string()), net)
    points = S._points(data)
    return [
        [(S.KINDS[k], int(points[s] - points[offsets[i]]), int(points[e] - points[offsets[i]])) for s, k, e in spans.get(i, ())]
        for i in range(len(texts))
    ]


def test_keys_in_the_middle_of_long_runs(net):
    rng = np.random.default_rng(5)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    path, tail = "see //host.example.com/v1/hooks/callback/", "/return/to/the/first/page"
    texts = [path + "ghp_" + "".join(rng.choice(letters, 36)) + tail for _ in range(40)]
    harmless = [path + "some/other/path" + tail] * 2
    got = reported(net, texts + harmless)
    assert sum(any(s <= len(path) and e >= len(path) + 40 for _, s, e in x) for x in got[:40]) >= 38
    assert got[40:] == [[], []]


def test_secrets_beside_matches_and_without_digits(net):
    rng = np.random.default_rng(6)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))

    def draw(n):
        return "".join(rng.choice(letters, n))

    keys = [f"AKIA{draw(16).upper()}/{draw(39)}7" for _ in range(30)]
    keys += [f"1234567890123456.{draw(40)}" for _ in range(30)]
    keys += [draw(40) for _ in range(30)]
    for key, own in zip(keys, reported(net, ["some words key: " + k + " more words" for k in keys])):
        assert any(kind == "model" and e == 16 + len(key) for kind, _, e in own), (key, own)


def planted(rows, many, seed):
    """Keys of four kinds that no pattern names, at random places of the texts."""
    rng = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def draw(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    kinds = [
        lambda: "ghp_" + draw(letters, 36),
        lambda: "npm_" + draw(letters, 36),
        lambda: draw(letters, 40),
        lambda: "-".join(draw("0123456789ABCDEF", n) for n in (8, 4, 4, 4, 12)),
    ]
    texts, where = dict(rows), {}
    for n, i in enumerate(rng.sample(sorted(i for i, t in rows if t and " " in t), many)):
        text, key = texts[i], kinds[n % 4]()
        at = rng.choice([k for k, c in enumerate(text) if c == " "]) + 1
        texts[i], where[i] = text[:at] + key + " " + text[at:], (at, at + len(key), n % 4)
    return texts, where


@pytest.mark.parametrize("many", [10, 200, 500])
def test_keys_of_the_corpus_are_not_taught_as_harmless(spark, many):
    """The network is trained on the very table that holds the keys."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    texts, where = planted([tuple(r) for r in docs.collect()], many, many)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(8)
    found, of_kind, others = [0] * 4, [0] * 4, 0
    for r in S.secrets(df, S.trained(df)).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x.startswith("model")]
        if r.doc_id in where:
            start, end, kind = where[r.doc_id]
            of_kind[kind] += 1
            found[kind] += any(int(s) <= start and int(e) >= end for _, s, e in spans)
        else:
            others += bool(spans)
    assert all(f >= 0.9 * n for f, n in zip(found, of_kind))
    assert others <= 0.01 * len(texts)


def corpus(spark, changed=()):
    """5000 short documents, more than the 4000 once sampled; `changed` ones are other texts."""
    rows = []
    for i in range(5000):
        rng = random.Random(i + 5000 * (i in changed))
        words = " ".join(rng.choice(["the", "plain", "short", "words", "of", "it"]) for _ in range(6))
        key = f"token = {rng.getrandbits(90):x}Zq" if i % 2 else f"{words.replace(' ', '/')}"
        rows.append((i, f"{words} {key} {words}" if i % 7 else None))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_findings_of_all_documents_teach(spark):
    how = S.Secrets(made=30, share=256)
    df = corpus(spark).select("text")
    views = {}
    for part in S._taught(how)(pa.RecordBatch.from_pydict({"text": [r.text]}) for r in df.collect()):
        for view, label in zip(*(c.to_pylist() for c in part.columns)):
            views[view] = max(label, views.get(view, -1))
    made, labels = S._generated(how)
    views |= {r.astype(np.uint8).tobytes(): int(n) for r, n in zip(made, labels)}
    assert sum(n == S.KEY for n in views.values()) > 2000
    lessons = S.lessons(df, how)
    assert {bytes(r.view): r.label for r in lessons.collect()} == views

    # Every share, once; what is summed up over them is what one machine finds.
    shares = S._shares(lessons, how.share)
    packed = shares.toArrow().to_batches()
    got = {r.astype(np.uint8).tobytes(): n for rows, labels, _ in S._each(packed) for r, n in zip(rows, labels)}
    assert got == views and shares.count() > 10
    net = charnet.train(made, labels.astype(float), 1)
    aside = [(r[a & (n >= 0)], n[a & (n >= 0)]) for r, n, a in S._each(packed)]
    rows, labels = (np.concatenate(x) for x in zip(*aside))
    measured = S._measured(shares, net)
    scale = S._scale(measured)
    whole = charnet.calibrate(net, rows, labels.astype(float), 0.9)
    assert scale == pytest.approx(whole.scale, rel=1e-4)
    found = np.sort(charnet.likely(charnet.logits(net, rows), scale)[labels == S.KEY])
    assert S._threshold(measured, scale, 0.9) == pytest.approx(found[charnet.rank(0.9, len(found))], rel=1e-9)


def test_the_network_depends_on_every_document_but_not_on_partitions(spark):
    """Other texts, in documents that a sample of 4000 by hash would leave out, teach as well."""
    how = S.Secrets(made=30)
    df, ids = corpus(spark), range(1, 5000, 2)
    once = S.trained(df.repartition(3), how=how)
    again = S.trained(df.repartition(11, "text"), how=how)
    assert all((a == b).all() for a, b in zip(once.weights(), again.weights()))
    assert (once.scale, once.threshold) == (again.scale, again.threshold)

    def left_out(frame):
        chosen = picked(frame.select("doc_id", "text"), 4000, "doc_id", "text", seed=11)
        return {r.doc_id for r in frame.select("doc_id").collect()} - {
            r.doc_id for r in chosen.collect()
        }

    changed = sorted(left_out(df) & left_out(corpus(spark, set(ids))) & set(ids))
    assert len(changed) > 20
    other = S.trained(corpus(spark, set(changed)), how=how)
    assert any((a != b).any() for a, b in zip(once.weights(), other.weights()))
