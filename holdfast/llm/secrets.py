"""Secret scans: fixed patterns, and a character network over every other candidate.

Patterns (kinds `assign`, `access`, `hex`) always report. A candidate is a run of 16 or more
characters that keys are made of, without the patterns' matches in it; the network
sees it with its surroundings, a long one in overlapping stretches and parts as well, and
reports it (kind `model`) if the largest probability is above its threshold.

The network is trained on labelled findings of all documents: those that the patterns label, and
generated keys and look-alikes, one put into a place of every document and some in plain words.
What no pattern names is not known to be harmless: a first network, trained without it, leaves
out whatever it does not call unlikely, so keys of the corpus itself are never taught as harmless.
A third is kept aside for calibration; the threshold is the largest that still finds the share
`recall` of all secrets kept aside.

Findings are split by hash into shares. In each round every share trains the network by itself,
all shares at once, and the weights are averaged. Sums over shares are of whole numbers, so
neither partitions nor their order matter; the driver receives such sums only.

Cases: null texts are empty; a text without findings has empty spans. Very long texts are scanned
whole. Offsets are code points, ends exclusive. Repeated rows get equal findings, and equal
findings teach once. Documents without findings leave the generated ones, as does an empty table,
whose result is empty; a text without spaces has no place for a generated one. Other
columns are ignored, and kept as they are by `redact`.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm import charnet
from holdfast.llm.text import buffers, slices
from holdfast.session import cut_lineage

# Fixed patterns of the contract, on UTF-8 bytes.
ASSIGN = re.compile(
    rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "model")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(string.digits.encode())] = True
_JOINT = np.zeros(256, bool)
_JOINT[list(b"/._=-")] = True
_KEY = np.zeros(256, bool)
_KEY[list((string.ascii_letters + string.digits + "+/_.=-").encode())] = True


@dataclass(frozen=True)
class Secrets:
    """`made` findings of each label are generated in plain words, besides those in the places
    of the documents; `recall` constrains the threshold. Candidates of the corpus count as
    harmless below the probability `unlikely` only. `share` findings or so train at a time, in
    `rounds` rounds.
    """

    made: int = 2000
    share: int = 4096
    rounds: int = 4
    recall: float = 0.98
    unlikely: float = 0.1
    seed: int = 11
    mark: str = "[SECRET]"


def _runs(member: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least `least` bytes that do not cross from one text to the next."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]])))
    start, end = edge[::2], edge[1::2]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(member))])
    cuts = cuts[member[cuts] & member[cuts - 1]]
    start, end = np.sort(np.append(start, cuts)), np.sort(np.append(end, cuts))
    long = end - start >= least
    return start[long], end[long]


def _hinted(low: bytes, words: tuple[bytes, ...], offsets: np.ndarray) -> set[int]:
    """Texts in which one of the words occurs."""
    at = [m.start() for w in words for m in re.finditer(re.escape(w), low)]
    return set((np.searchsorted(offsets, at, "right") - 1).tolist()) if at else set()


def scan(texts: pa.Array):
    """Per text the pattern matches as (start, kind, end) in bytes, and the other candidates.

    Returns (bytes, offsets, matches by text, candidate starts, ends and texts, and which
    candidates are what matches left of a run).
    """
    data, offsets = buffers(texts)
    raw = data.tobytes()
    found: dict[int, list[tuple[int, int, int]]] = {}
    for i in _hinted(raw.lower(), HINTS, offsets):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        for m in ASSIGN.finditer(raw[lo:hi]):
            if m.end(1) - m.start(1) >= 12:
                found.setdefault(i, []).append((lo + m.start(), 0, lo + m.end()))
    for i in _hinted(raw, (b"AKIA",), offsets):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        for m in ACCESS.finditer(raw[lo:hi]):
            if m.end() - m.start() >= 18:
                found.setdefault(i, []).append((lo + m.start(), 1, lo + m.end()))
    start, end = _runs(_HEX[data], offsets, 16)
    owner = np.searchsorted(offsets, start, "right") - 1
    for i, s, e in zip(owner.tolist(), start.tolist(), end.tolist()):
        found.setdefault(i, []).append((s, 2, e))
    for spans in found.values():
        spans.sort()

    start, end = _runs(_KEY[data], offsets, 16)
    owner = np.searchsorted(offsets, start, "right") - 1
    rest = [
        (i, lo, hi, cut)
        for i, s, e in zip(owner.tolist(), start.tolist(), end.tolist())
        for lo, hi, cut in _remainders(s, e, found.get(i, ()))
    ]
    rest = np.array(rest, np.int64).reshape(-1, 4)
    return data, offsets, found, rest[:, 1], rest[:, 2], rest[:, 0], rest[:, 3] > 0


def _remainders(start: int, end: int, spans) -> list[tuple[int, int, bool]]:
    """What the matches leave of a run, in parts of 16 or more: (start, end, touched).

    The whole run, if that many characters are left in shorter parts only.
    """
    parts, at, touched = [], start, False
    for s, _, e in spans:
        if s < end and e > start:
            touched = True
            if s > at:
                parts.append((at, s))
            at = max(at, e)
    if at < end:
        parts.append((at, end))
    long = [(s, e, touched) for s, e in parts if e - s >= 16]
    if not long and sum(e - s for s, e in parts) >= 16:
        return [(start, end, touched)]
    return long


def _views(data, offsets, start, end, owner) -> np.ndarray:
    """Network input of each span."""
    return charnet.view(data, offsets[owner], offsets[owner + 1], start, end)


def _looks(data, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the network looks at: (start, end, which span), in order of the spans.

    A span that a view shows whole is one look. Of a longer one, overlapping stretches of that
    width and the parts between separators are looked at too, so nothing in it stays unseen.
    """
    wide = charnet.HEAD + charnet.TAIL
    long = np.flatnonzero(end - start > wide)
    starts, ends, which = [start], [end], [np.arange(len(start))]
    for k in long.tolist():
        lo, hi = int(start[k]), int(end[k])
        first = np.append(np.arange(lo, hi - wide, wide // 2), hi - wide)
        plain = np.concatenate([[False], ~_JOINT[data[lo:hi]], [False]])
        edge = lo + np.flatnonzero(np.diff(plain))
        some = edge[1::2] - edge[::2] >= 16
        starts += [first, edge[::2][some]]
        ends += [first + wide, edge[1::2][some]]
        which.append(np.full(len(first) + int(some.sum()), k))
    starts, ends, which = (np.concatenate(x).astype(np.int64) for x in (starts, ends, which))
    order = np.argsort(which, kind="stable")
    return starts[order], ends[order], which[order]


def _likely(net: charnet.Net, data, offsets, start, end, owner, block: int = 4096) -> np.ndarray:
    """The largest probability of each span over all looks at it."""
    best = np.zeros(len(start))
    s, e, which = _looks(data, start, end)
    for at in range(0, len(s), block):
        now = slice(at, at + block)
        rows = _views(data, offsets, s[now], e[now], owner[which[now]])
        np.maximum.at(best, which[now], charnet.probability(net, rows))
    return best


def findings(texts: pa.Array, net: charnet.Net):
    """(bytes, offsets, per text its (start, kind, end) in bytes, the network's included)."""
    data, offsets, found, start, end, owner, _ = scan(texts)
    if len(start):
        likely = _likely(net, data, offsets, start, end, owner)
        for i, s, e, p in zip(owner.tolist(), start.tolist(), end.tolist(), likely.tolist()):
            if p >= net.threshold:
                found.setdefault(i, []).append((s, 3, e))
        for spans in found.values():
            spans.sort()
    return data, offsets, found


# --- labelled findings


# Labels; of several for one view the largest counts.
KEY, HARMLESS, UNKNOWN = 1, 0, -1

OPENINGS = ["", '"', "=", "key: ", "auth ", ": ", "= ", "(", "id="]


def _draw(rng, alphabet: str, n: int) -> str:
    return "".join(alphabet[k] for k in rng.integers(0, len(alphabet), n))


def _word(rng, lo: int = 2, hi: int = 9) -> str:
    return _draw(rng, string.ascii_lowercase, int(rng.integers(lo, hi)))


_DIGITS, _UPPER = string.digits, "0123456789ABCDEF"
_ALNUM = string.ascii_letters + string.digits

# Keys of known kinds, and look-alikes: hosts, files, dates, versions.
_MADE: dict[int, list[Callable]] = {
    KEY: [
        lambda r: _draw(r, "0123456789abcdef", int(r.choice([32, 40, 64]))),
        lambda r: _draw(r, _UPPER, int(r.choice([32, 40, 64]))),
        lambda r: "AKIA" + _draw(r, string.ascii_uppercase + _DIGITS, 16),
        lambda r: "ghp_" + _draw(r, _ALNUM, 36),
        lambda r: "sk_live_" + _draw(r, _ALNUM, 24),
        lambda r: "xoxb-" + _draw(r, _DIGITS, 12) + "-" + _draw(r, _ALNUM, 24),
        lambda r: "eyJ" + _draw(r, _ALNUM, 33) + "." + _draw(r, _ALNUM + "_-", 60),
        lambda r: _draw(r, _ALNUM + "+/", int(r.integers(24, 64))) + "=" * int(r.integers(0, 3)),
        lambda r: "-".join(_draw(r, _UPPER, n) for n in (8, 4, 4, 4, 12)),
        lambda r: _draw(r, _ALNUM, int(r.integers(20, 48))),
    ],
    HARMLESS: [
        lambda r: f"{_word(r)}{r.integers(1, 99)}.{_word(r, 4)}{r.integers(1, 9)}.example.com",
        lambda r: f"{_word(r, 4)}_{_word(r, 4)}-{r.integers(1990, 2030)}-{r.integers(10, 13)}.txt",
        lambda r: f"{r.integers(1990, 2030)}-{_draw(r, '01', 2)}-{_draw(r, '012', 2)}"
        f"T{_draw(r, '01', 2)}.{_draw(r, '012345', 2)}.{_draw(r, '012345', 2)}",
        lambda r: f"www.{_word(r, 4)}.example.net/{_word(r)}/{_word(r)}/{r.integers(1, 9999)}",
        lambda r: f"{_word(r, 5)}-{_word(r, 5)}-{_word(r, 5)}-{r.integers(1, 99)}",
        lambda r: f"/{_word(r)}/{_word(r)}/{_word(r)}/v{r.integers(1, 9)}.{r.integers(0, 30)}.0",
        lambda r: ".".join(str(k) for k in r.integers(1000, 99999, 4)),
        lambda r: "-" * int(r.integers(14, 40)) + str(r.integers(0, 99)),
        lambda r: f"{_word(r, 9, 14)}{_word(r, 6, 9)}{r.integers(1, 9)}",
    ],
}


def _generated(how: Secrets) -> tuple[np.ndarray, np.ndarray]:
    """Keys of known kinds and look-alikes, in plain words."""
    rng = np.random.default_rng(how.seed)
    rows, labels = [], []
    for label, makers in _MADE.items():
        for k in range(how.made):
            value = makers[k % len(makers)](rng).encode()
            opening = OPENINGS[int(rng.integers(0, len(OPENINGS)))]
            front = (" ".join(_word(rng) for _ in range(5)) + " " + opening).encode()
            back = (" " + " ".join(_word(rng) for _ in range(3))).encode()
            data = np.frombuffer(front + value + back, np.uint8)
            span = np.array([len(front)]), np.array([len(front) + len(value)])
            rows.append(charnet.view(data, 0, len(data), *span)[0])
            labels.append(label)
    return np.array(rows), np.array(labels)


def _planted(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One generated key or look-alike in every text, at some white space of it; half of them
    with an opening. The text's bytes decide on everything."""
    pieces, spans, labels, at = [], [], [], 0
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        gaps = lo + np.flatnonzero(data[lo:hi] == 0x20)
        if not len(gaps):
            continue
        rng = np.random.default_rng([seed, zlib.crc32(data[lo:hi].tobytes())])
        gap, label, kind, half, opening = rng.integers(0, [len(gaps), 2, 1 << 20, 2, len(OPENINGS)])
        gap, label = int(gaps[gap]), int(label)
        value = _MADE[label][kind % len(_MADE[label])](rng).encode()
        front = data[max(lo, gap + 1 - charnet.BEFORE) : gap + 1].tobytes()
        front += OPENINGS[opening].encode() if half else b""
        back = data[gap : min(hi, gap + charnet.AFTER)].tobytes()
        pieces += [front, value, back]
        end = at + len(front) + len(value) + len(back)
        spans.append((at, end, at + len(front), end - len(back)))
        labels.append(label)
        at = end
    lo, hi, start, end = np.array(spans, np.int64).reshape(-1, 4).T
    whole = np.frombuffer(b"".join(pieces), np.uint8)
    return charnet.view(whole, lo, hi, start, end), np.array(labels, np.int64)


def _taught(how: Secrets):
    """Network input and label of each finding: a key that a pattern names, a candidate that
    none matches, or a generated one. Runs of digits alone are either, so they are left out."""

    def taught(batches):
        for part in slices(batches, "text"):
            data, offsets, found, start, end, owner, cut = scan(part.column("text"))
            # What is left beside a key may be a key.
            start, end, owner = start[~cut], end[~cut], owner[~cut]
            sure = [
                (i, s, e)
                for i, spans in sorted(found.items())
                for s, kind, e in spans
                if kind < 2 or not _DIGIT[data[s:e]].all()
            ]
            keys = np.array(sure, np.int64).reshape(-1, 3)
            yield _labelled(
                _views(data, offsets, keys[:, 1], keys[:, 2], keys[:, 0]),
                np.full(len(keys), KEY),
            )
            yield _labelled(*_planted(data, offsets, how.seed))
            start, end, which = _looks(data, start, end)
            for at in range(0, len(start), 4096):
                now = slice(at, at + 4096)
                views = _views(data, offsets, start[now], end[now], owner[which[now]])
                yield _labelled(views, np.full(len(views), UNKNOWN))

    return taught


def _labelled(rows: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    views = pa.array([r.tobytes() for r in rows.astype(np.uint8)], pa.binary())
    return pa.RecordBatch.from_arrays([views, pa.array(labels, pa.int32())], ["view", "label"])


def lessons(texts: DataFrame, how: Secrets) -> DataFrame:
    """(view, label) of all distinct findings of all rows, and the generated ones."""
    own = texts.select("text").mapInArrow(_taught(how), "view binary, label int")
    made = pa.Table.from_batches([_labelled(*_generated(how))])
    made = texts.sparkSession.createDataFrame(made, "view binary, label int")
    return own.unionByName(made).groupBy("view").agg(F.max("label").alias("label"))


# --- shares of the findings, each as one row of (views, labels)


def _shares(rows: DataFrame, share: int) -> DataFrame:
    """The findings by hash of their view in shares of about `share`, each in order."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    many = max(1, -(-rows.count() // share))
    own = rows.withColumn("share", F.pmod(F.xxhash64("view"), F.lit(many)))

    def packed(found: pa.Table) -> pa.Table:
        found = found.sort_by("view")
        views = b"".join(found.column("view").to_pylist())
        labels = found.column("label").to_numpy().astype(np.int8).tobytes()
        return pa.table({"views": pa.array([views]), "labels": pa.array([labels])})

    # Files of at most 64 shares or so, and enough of them for all cores.
    parts = own.repartitionByRange(min(many, max(4 * cores, many // 64)), "share")
    return cut_lineage(
        parts.groupBy("share").applyInArrow(packed, "views binary, labels binary")
    )


def _each(batches):
    """(rows, labels, kept aside) of each share."""
    for batch in batches:
        for views, labels in zip(batch.column("views"), batch.column("labels")):
            rows = np.frombuffer(views.as_buffer(), np.uint8).reshape(-1, charnet.LENGTH)
            labels = np.frombuffer(labels.as_buffer(), np.int8).astype(np.int64)
            yield rows.astype(np.int64), labels, _aside(rows)


def _aside(rows: np.ndarray) -> np.ndarray:
    """A third, by the view alone, so that no network learns what another is measured on."""
    rows = rows.astype(np.uint8)
    return np.array([zlib.crc32(r.tobytes()) % 3 == 0 for r in rows], bool)


def _whole(x: np.ndarray, bits: int) -> np.ndarray:
    return np.rint(x * 2.0**bits).astype(np.int64)


def _total(shares: DataFrame, numbers) -> np.ndarray:
    """Sums of arrays of whole numbers; `numbers` makes those of each share from the batches."""

    def add(batches):
        total = sum(numbers(batches))
        if isinstance(total, np.ndarray):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    own = shares.mapInArrow(add, "at bigint, n bigint").groupBy("at")
    found = own.agg(F.sum(F.col("n").cast("decimal(19,0)")).alias("n")).collect()
    total = np.zeros(1 + max((r["at"] for r in found), default=0))
    for r in found:
        total[r["at"]] = r["n"]
    return total


def _round(shares: DataFrame, net: charnet.Net, how: Secrets, rate: float) -> charnet.Net:
    """Every share trains a copy of the network; the copies are averaged by their findings."""
    sizes = [w.size for w in net.weights()]

    def trained_apart(batches):
        for rows, labels, aside in _each(batches):
            own = ~aside & (labels != UNKNOWN)
            n = int(own.sum())
            if n:
                mine = charnet.train(rows[own], labels[own], how.seed, 1, start=net, rate=rate)
                flat = np.concatenate([w.ravel() for w in mine.weights()])
                yield np.append(_whole(n * flat, 28), n)

    total = _total(shares, trained_apart)
    if len(total) <= sum(sizes):
        return net
    parts = np.split(total[:-1] / 2.0**28 / total[-1], np.cumsum(sizes)[:-1])
    return charnet.Net(*(p.reshape(w.shape) for p, w in zip(parts, net.weights())))


def _measured(shares: DataFrame, net: charnet.Net) -> DataFrame:
    """(logits, labels) of the findings kept aside, by share."""

    def measure(batches):
        for rows, labels, aside in _each(batches):
            own = aside & (labels != UNKNOWN)
            logit = charnet.logits(net, rows[own])
            yield pa.RecordBatch.from_arrays(
                [pa.array([logit.tobytes()]), pa.array([labels[own].tobytes()])],
                ["logits", "labels"],
            )

    return cut_lineage(shares.mapInArrow(measure, "logits binary, labels binary"))


def _logits(batches):
    for batch in batches:
        for logit, labels in zip(batch.column("logits"), batch.column("labels")):
            yield np.frombuffer(logit.as_buffer()), np.frombuffer(labels.as_buffer(), np.int64)


def _scale(measured: DataFrame) -> tuple[float, float]:
    """Slope and offset of the probability, from all findings kept aside."""

    def count(batches):
        for _, labels in _logits(batches):
            yield np.array([(labels == HARMLESS).sum(), (labels == KEY).sum()], np.int64)

    bad, good = np.append(_total(measured, count), 0)[:2]

    def sums(scale):
        def add(batches):
            for logit, labels in _logits(batches):
                yield _whole(charnet.slopes(logit, labels, good, bad, scale), 32)

        total = _total(measured, add) / 2.0**32
        return np.append(total, np.zeros(5))[:5]

    return charnet.fitted_scale(sums, 1e-6)


def _threshold(measured: DataFrame, scale: tuple[float, float], recall: float) -> float:
    """The largest threshold that finds the share `recall` of all secrets kept aside."""

    # Bits of numbers from 0 to 1 are in the order of the numbers.
    def bits(batches):
        for logit, labels in _logits(batches):
            yield charnet.likely(logit[labels == KEY], scale).view(np.int64)

    def counted(shift: int, high: int):
        def count(batches):
            for own in bits(batches):
                own = own >> shift
                yield np.bincount(own[own >> 16 == high] & 0xFFFF, minlength=1 << 16)

        return np.cumsum(_total(measured, count)).astype(np.int64)

    high, below = 0, None
    for shift in (48, 32, 16, 0):
        upto = counted(shift, high)
        if below is None:
            if not upto[-1]:
                return 0.5
            below = charnet.rank(recall, int(upto[-1]))
        at = int(np.searchsorted(upto, below, "right"))
        below -= int(upto[at - 1]) if at else 0
        high = high << 16 | at
    return float(np.array(high, np.int64).view(float))


def _fitted(
    shares: DataFrame, start: charnet.Net, how: Secrets
) -> tuple[charnet.Net, DataFrame]:
    """Rounds on two thirds, calibration on the rest; and the logits of the rest."""
    net = start
    for k in range(how.rounds):
        net = _round(shares, net, how, 0.004 / 2**k)
    measured = _measured(shares, net)
    net.scale = _scale(measured)
    return net, measured


def _judged(shares: DataFrame, net: charnet.Net, unlikely: float) -> DataFrame:
    """The shares with unknown findings taken as harmless, if unlikely, or else left out."""

    def judge(batches):
        for rows, labels, _ in _each(batches):
            labels = labels.copy()
            unknown = np.flatnonzero(labels == UNKNOWN)
            low = unknown[charnet.probability(net, rows[unknown]) < unlikely]
            labels[low] = HARMLESS
            own = labels != UNKNOWN
            views, labels = rows[own].astype(np.uint8), labels[own].astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([views.tobytes()]), pa.array([labels.tobytes()])], ["views", "labels"]
            )

    return cut_lineage(shares.mapInArrow(judge, "views binary, labels binary"))


def trained(
    docs: DataFrame,
    text_column: str = "text",
    how: Secrets = Secrets(),
) -> charnet.Net:
    """The network, from the findings of all documents."""
    texts = docs.select(F.col(text_column).alias("text"))
    shares = _shares(cut_lineage(lessons(texts, how)), how.share)
    # A common start, so that the shares' networks can be averaged.
    rows, labels = _generated(how)
    own = ~_aside(rows)
    start = charnet.train(rows[own], labels[own].astype(float), how.seed)
    first, _ = _fitted(shares, start, how)
    net, measured = _fitted(_judged(shares, first, how.unlikely), first, how)
    net.threshold = _threshold(measured, net.scale, how.recall)
    return net


# --- results


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, s, e in spans)


def _points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def secrets(
    docs: DataFrame,
    net: charnet.Net,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_model, base_sha256, spans) for every row."""

    def found(batches):
        for part in slices(batches, "text"):
            data, offsets, spans = findings(part.column("text"), net)
            points = _points(data)
            counts: list[list[int]] = [[], [], [], []]
            digests, every = [], []
            for i in range(part.num_rows):
                base = points[offsets[i]]
                own = [
                    (KINDS[k], int(points[s] - base), int(points[e] - base))
                    for s, k, e in spans.get(i, ())
                ]
                for k, name in enumerate(KINDS):
                    counts[k].append(sum(kind == name for kind, _, _ in own))
                sure = _joined([x for x in own if x[0] != "model"])
                digests.append(hashlib.sha256(sure.encode()).hexdigest())
                every.append(_joined(own))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *(pa.array(c, pa.int64()) for c in counts)]
                + [pa.array(digests), pa.array(every)],
                ["id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"],
            )

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    fields = "id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_model bigint"
    named = rows.mapInArrow(found, f"{fields}, base_sha256 string, spans string")
    return named.withColumnRenamed("id", id_column)


def redact(
    docs: DataFrame,
    net: charnet.Net,
    text_column: str = "text",
    length_column: str | None = None,
    how: Secrets = Secrets(),
) -> DataFrame:
    """`docs` with every finding in the text replaced by a mark; overlapping ones by one mark.

    `length_column`, if given, gets the new number of code points of a changed text.
    """
    at = docs.columns.index(text_column)
    counted = docs.columns.index(length_column) if length_column else None
    mark = how.mark.encode()

    def cleaned(batches):
        for part in slices(batches, text_column):
            texts = part.column(at)
            data, offsets, spans = findings(texts, net)
            new, sizes = texts.to_pylist(), None
            if counted is not None:
                sizes = part.column(counted).to_pylist()
            for i, own in spans.items():
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                pieces, upto = [], lo
                for s, _, e in own:
                    if s >= upto:
                        pieces += [data[upto:s].tobytes(), mark]
                    upto = max(upto, e)
                pieces.append(data[upto:hi].tobytes())
                new[i] = b"".join(pieces).decode()
                if sizes is not None:
                    sizes[i] = len(new[i])
            columns = list(part.columns)
            columns[at] = pa.array(new, texts.type)
            if sizes is not None:
                columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(cleaned, docs.schema)
