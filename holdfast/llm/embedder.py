"""Supervised subword embeddings: the vectors of hashed n-grams, averaged, then a softmax.

The features of a text are its words, its pairs of neighbouring words, the character
n-grams of its words with their boundaries, one line end per line, and one mark for
each three words that stand earlier in the text already, whatever they are. Every feature
is hashed to one of `buckets` learned vectors. A text is the average of its features'
vectors; a linear layer and a softmax over the two classes follow. All is learned together by
stochastic gradient descent in numpy, with a step that falls linearly to zero.

The layer is linear, so a text's logit is the average of one number per bucket. Scoring
keeps only those numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from holdfast.llm.text import PIECE, buffers, mix, runs, words

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
# What line ends and repeated word triples are hashed to.
_LINE, _AGAIN = _U(0x51ED270B153A4D2F), _U(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Embedder:
    """About `sample` labelled texts are learned from, by at least `updates` steps, one
    text each; `shapes` are lengths of n-grams."""

    sample: int = 2000
    buckets: int = 1 << 16
    width: int = 12
    shapes: tuple[int, ...] = (2, 3, 4)
    updates: int = 12_000
    step: float = 0.5
    seed: int = 17


@dataclass
class Weights:
    """What scoring needs: the logit of each bucket, and the offset."""

    logit: np.ndarray
    offset: float


def _grams(texts: list[str], shapes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of the character n-grams; white space is only ever at their ends."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    joined = " " + " ".join(texts) + " "
    longest = max(shapes)
    for at in range(0, len(joined), PIECE):
        part = joined[at : at + PIECE + longest - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
        codes = np.where(space, 0x20, codes).astype(np.uint64)
        inner = np.concatenate([[0], np.cumsum(space)])
        for n in shapes:
            m = min(len(codes) - n + 1, PIECE)
            if m <= 0:
                continue
            # No white space strictly inside, and not white space alone.
            keep = inner[n : n + m] - inner[:m] < n
            if n > 2:
                keep &= inner[n - 1 : n - 1 + m] == inner[1 : 1 + m]
            where = np.flatnonzero(keep)
            total = np.full(len(where), n, np.uint64)
            for k in range(n):
                total = total * _U(0xD6E8FEB86659FD93) + codes[where + k]
            yield np.searchsorted(starts, np.maximum(where + at, 0), "right") - 1, mix(total)


def features(texts: pa.Array, how: Embedder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every feature of the texts, in some parts."""
    data, offsets = buffers(texts)
    found = words(data, offsets)
    owner = found.texts()
    mask = _U(how.buckets - 1)
    yield owner, (mix(found.hash + _ODD) & mask).astype(np.int64)
    if len(owner) > 1:
        same = owner[1:] == owner[:-1]
        pairs = runs(found.hash, 2)[same]
        yield owner[1:][same], (pairs & mask).astype(np.int64)
    if len(owner) > 2:
        whole = owner[2:] == owner[:-2]
        triples = np.stack([owner[2:][whole].astype(np.uint64), runs(found.hash, 3)[whole]])
        order = np.lexsort(triples[::-1])
        who, triple = triples[:, order]
        again = (who[1:] == who[:-1]) & (triple[1:] == triple[:-1])
        yield who[1:][again].astype(np.int64), np.full(int(again.sum()), int(_AGAIN & mask))
    lines = np.flatnonzero(data == 0x0A)
    ends = np.searchsorted(offsets, lines, "right") - 1
    ends = np.concatenate([ends, np.arange(len(offsets) - 1)])
    yield ends, np.full(len(ends), int(_LINE & mask), np.int64)
    filled = ["" if t is None else t for t in texts.to_pylist()]
    for who, hashes in _grams(filled, how.shapes):
        yield who, (hashes & mask).astype(np.int64)


def counted(texts: pa.Array, how: Embedder) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets, in order, and how often each occurs."""
    n = len(texts)
    keys = [who * how.buckets + bucket for who, bucket in features(texts, how)]
    keys, counts = np.unique(np.concatenate(keys), return_counts=True)
    at = np.searchsorted(keys, np.arange(n + 1) * how.buckets)
    return [
        ((keys[lo:hi] % how.buckets).astype(np.int32), counts[lo:hi].astype(np.int32))
        for lo, hi in zip(at[:-1], at[1:])
    ]


def learned(rows: list[tuple[np.ndarray, np.ndarray, int]], how: Embedder) -> Weights:
    """Train on (buckets, counts, label) rows. Without both labels the answer is even."""
    labels = np.array([label for _, _, label in rows])
    if not len(rows) or labels.min() == labels.max():
        # One class alone says nothing about the other: its share, smoothed.
        share = (labels.sum() + 1) / (len(rows) + 2) if len(rows) else 0.5
        return Weights(np.zeros(how.buckets, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(how.seed)
    vectors = rng.uniform(-1, 1, (how.buckets, how.width)).astype(np.float32) / how.width
    layer = np.zeros((how.width, 2), np.float32)
    offset = np.zeros(2, np.float32)
    rows = [(b, (c / c.sum()).astype(np.float32), label) for b, c, label in rows]
    epochs = -(-how.updates // len(rows))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, share, label = rows[i]
            step = np.float32(how.step * (1 - done / steps))
            done += 1
            mean = share @ vectors[bucket]
            logit = mean @ layer + offset
            chance = np.exp(logit - logit.max())
            chance /= chance.sum()
            chance[label] -= 1
            back = layer @ chance
            layer -= step * np.outer(mean, chance)
            offset -= step / 10 * chance
            vectors[bucket] -= np.outer(share, step * how.width * back)
    return Weights(
        (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(offset[1] - offset[0])
    )


def scores(texts: pa.Array, weights: Weights, how: Embedder) -> np.ndarray:
    """The probability of label 1 of each text."""
    total, number = np.zeros(len(texts)), np.zeros(len(texts))
    for who, bucket in features(texts, how):
        total += np.bincount(who, weights.logit[bucket], len(texts))
        number += np.bincount(who, minlength=len(texts))
    return 1 / (1 + np.exp(-(total / np.maximum(number, 1) + weights.offset)))
