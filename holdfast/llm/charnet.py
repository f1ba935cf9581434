"""A small character convolutional network in numpy: one convolution, three pooled fields.

A candidate is seen as a row of character classes: some characters before it, its own
beginning and end, and some after it. Filters slide over the whole row; their largest
responses in each of the three fields go through one hidden layer to a logit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BEFORE, HEAD, TAIL, AFTER = 24, 28, 12, 12
LENGTH = BEFORE + HEAD + TAIL + AFTER
FIELDS = ((0, BEFORE), (BEFORE, BEFORE + HEAD + TAIL), (BEFORE + HEAD + TAIL, LENGTH))
REACH = 5

# Class 0 is beyond the text, 1 any byte above 127, then one class per ASCII character.
CLASSES = 130


@dataclass
class Net:
    letters: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    # Logit to probability: slope and offset; and the least probability to report.
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def weights(self) -> list[np.ndarray]:
        return [self.letters, self.filters, self.bias, self.hidden, self.shift, self.out]


def view(data: np.ndarray, lo, hi, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Character classes around the spans of a text that lies at `data[lo:hi]`, or around one
    span of each text, if `lo` and `hi` are arrays."""
    if not len(starts):
        return np.zeros((0, LENGTH), np.int64)
    lo, hi = np.reshape(lo, (-1, 1)), np.reshape(hi, (-1, 1))
    before = starts[:, None] + np.arange(-BEFORE, 0)
    head = starts[:, None] + np.arange(HEAD)
    tail = ends[:, None] + np.arange(-TAIL, 0)
    after = ends[:, None] + np.arange(AFTER)
    head = np.where(head < ends[:, None], head, -1)
    tail = np.where(tail >= starts[:, None] + HEAD, tail, -1)
    at = np.concatenate([before, head, tail, after], axis=1)
    known = (at >= lo) & (at < hi)
    raw = data[np.where(known, at, 0)] if len(data) else np.zeros(at.shape, np.uint8)
    classes = np.where(raw > 127, 1, raw.astype(np.int64) + 2)
    return np.where(known, classes, 0)


def fresh(seed: int, width: int = 8, filters: int = 24, hidden: int = 16) -> Net:
    rng = np.random.default_rng(seed)

    def some(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    return Net(
        rng.normal(0, 0.5, (CLASSES, width)),
        some(REACH * width, filters),
        np.zeros(filters),
        some(len(FIELDS) * filters, hidden),
        np.zeros(hidden),
        some(hidden + 1, 1)[:, 0],
    )


def _pooled(net: Net, rows: np.ndarray):
    """Largest filter responses per field, and where they are."""
    width = net.letters.shape[1]
    # A row more, of zeros, for what lies beyond the ends.
    letters = np.append(net.letters, np.zeros((1, width)), axis=0)
    padded = np.pad(rows, ((0, 0), (REACH // 2, REACH // 2)), constant_values=CLASSES)
    response = np.broadcast_to(net.bias, (*rows.shape, len(net.bias))).copy()
    for k in range(REACH):
        response += (letters @ net.filters[k * width : (k + 1) * width])[padded[:, k : k + LENGTH]]
    where = np.stack([lo + response[:, lo:hi].argmax(axis=1) for lo, hi in FIELDS], axis=1)
    return where, np.take_along_axis(response, where, axis=1)


def logits(net: Net, rows: np.ndarray, block: int = 64) -> np.ndarray:
    parts = [np.zeros(0)]
    for at in range(0, len(rows), block):
        _, best = _pooled(net, rows[at : at + block])
        flat = np.maximum(best, 0).reshape(len(best), -1)
        inner = np.maximum(flat @ net.hidden + net.shift, 0)
        parts.append(inner @ net.out[:-1] + net.out[-1])
    return np.concatenate(parts)


def _gradients(net: Net, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    n = len(rows)
    where, best = _pooled(net, rows)
    pooled = np.maximum(best, 0)
    flat = pooled.reshape(n, -1)
    inner = np.maximum(flat @ net.hidden + net.shift, 0)
    logit = inner @ net.out[:-1] + net.out[-1]
    error = (1 / (1 + np.exp(-logit)) - labels) / n
    d_out = np.append(inner.T @ error, error.sum())
    d_inner = np.outer(error, net.out[:-1]) * (inner > 0)
    d_hidden, d_shift = flat.T @ d_inner, d_inner.sum(axis=0)
    d_best = (d_inner @ net.hidden.T).reshape(best.shape) * (best > 0)
    d_bias = d_best.sum(axis=(0, 1))
    # Only the window with the largest response of a filter learns from it.
    who = np.arange(n)[:, None, None]
    d_filters, d_letters = np.zeros_like(net.filters), np.zeros_like(net.letters)
    width = net.letters.shape[1]
    for k in range(REACH):
        own = slice(k * width, (k + 1) * width)
        place = where + k - REACH // 2
        known = (place >= 0) & (place < LENGTH)
        letter = rows[who, np.clip(place, 0, LENGTH - 1)]
        d_known = d_best * known
        # How much each filter learns from each letter at this place.
        at = letter * d_best.shape[2] + np.arange(d_best.shape[2])
        met = np.bincount(at.ravel(), d_known.ravel(), CLASSES * d_best.shape[2])
        met = met.reshape(CLASSES, -1)
        d_filters[own] = net.letters.T @ met
        d_letters += met @ net.filters[own].T
    return [d_letters, d_filters, d_bias, d_hidden, d_shift, d_out]


def train(
    rows: np.ndarray,
    labels: np.ndarray,
    seed: int,
    epochs: int = 6,
    batch: int = 64,
    start: Net | None = None,
    rate: float = 0.004,
) -> Net:
    """Adam on the mean log loss, from a fresh network or from a copy of `start`."""
    net, rng = fresh(seed), np.random.default_rng(seed + 1)
    if start is not None:
        net = Net(*(w.copy() for w in start.weights()))
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = order[at : at + batch]
            step += 1
            for w, g, m, v in zip(
                net.weights(), _gradients(net, rows[pick], labels[pick]), first, second
            ):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def slopes(logit: np.ndarray, labels: np.ndarray, good, bad, scale) -> np.ndarray:
    """Sums over some rows: first (two) and second (three) derivatives of the log loss by slope
    and offset, if there are `good` secrets and `bad` others in all."""
    # Smoothed targets keep the slope finite where the classes part cleanly.
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    p = likely(logit, scale)
    w = np.maximum(p * (1 - p), 1e-9)
    miss = p - target
    return np.array([x.sum() for x in (miss * logit, miss, w * logit**2, w * logit, w)])


def fitted_scale(sums, enough: float = 1e-9) -> tuple[float, float]:
    """Slope and offset of the probability by Newton steps; `sums` adds up `slopes` at a scale."""
    slope, offset = 1.0, 0.0
    for _ in range(200):
        g0, g1, h00, h01, h11 = sums((slope, offset))
        move = np.linalg.solve(np.array([[h00, h01], [h01, h11]]) + 1e-6 * np.eye(2), [g0, g1])
        move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-12))
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < enough:
            break
    return float(slope), float(offset)


def rank(recall: float, secrets: int) -> int:
    """How many of the secrets may lie below a threshold that finds the share `recall`."""
    return int(np.floor((1 - recall) * secrets))


def calibrate(net: Net, rows: np.ndarray, labels: np.ndarray, recall: float) -> Net:
    """Fit slope and offset of the probability, then the largest threshold with the recall."""
    logit = logits(net, rows)
    good, bad = labels.sum(), len(labels) - labels.sum()
    net.scale = fitted_scale(lambda scale: slopes(logit, labels, good, bad, scale))
    found = np.sort(probability(net, rows)[labels > 0])
    if len(found):
        net.threshold = float(found[rank(recall, len(found))])
    return net


def likely(logit: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scale[0] * logit + scale[1], -50, 50)))


def probability(net: Net, rows: np.ndarray) -> np.ndarray:
    return likely(logits(net, rows), net.scale)
