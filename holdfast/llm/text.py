"""Words and word shingles of whole Arrow batches, as numpy arrays.

A word is a run of bytes other than space and 0x09 to 0x0D. Texts stay in Arrow's own
buffers: no Python string is made per word. Hashes are 64 bits wide and depend on the
bytes alone, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"

# Bytes of text taken at a time; a longer text is cut at white space.
PIECE = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Every output bit depends on every input bit; one to one on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


class _Powers:
    """Powers of the hash base and of its inverse, made once per worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


class Words(NamedTuple):
    """All words of some texts in order: `bounds[i]` to `bounds[i + 1]` are those of text i."""

    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def texts(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE):
    """The batches in parts of at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def _cuts(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Parts of `most` bytes or so that cut no word."""
    at = 0
    while at < len(data):
        to = min(at + most, len(data))
        while to < len(data) and not _SPACE[data[to]]:
            more = np.flatnonzero(_SPACE[data[to : to + most]])
            to = to + int(more[0]) if len(more) else min(to + most, len(data))
        yield at, to
        at = to


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts begin and end."""
    starts, ends = [], []
    for lo, hi in _cuts(data, PIECE):
        part = data[lo:hi]
        inside = ~_SPACE[part]
        edge = np.empty(len(part) + 1, bool)
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        # A text may end in the middle of a run of other bytes.
        first, last = np.searchsorted(offsets, (lo + 1, hi), "left")
        new = offsets[first:last] - lo
        new = np.unique(new[(new > 0) & (new < len(part))])
        split = new[inside[new] & inside[new - 1]]
        at = np.flatnonzero(edge)
        if len(split):
            starts.append(np.sort(np.concatenate([at[::2], split])) + lo)
            ends.append(np.sort(np.concatenate([at[1::2], split])) + lo)
        else:
            starts.append(at[::2] + lo)
            ends.append(at[1::2] + lo)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order and hold no white space."""
    table = _BYTE[_LOWER if lower else _SAME]
    out = np.empty(len(start), np.uint64)
    for lo, hi in _cuts(data, PIECE):
        up, down = _Powers.upto(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=total[1:])
        a, b = np.searchsorted(start, (lo, hi))
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
    return out


def words(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False, trim: np.ndarray | None = None
) -> Words:
    """Words of the texts that `buffers` returned; `lower` takes A to Z as a to z.

    `trim` says for each byte whether to cut it from the ends of words; words that have
    nothing else are left out.
    """
    start, end = _spans(data, offsets)
    if trim is not None and len(start):
        cut = np.flatnonzero(trim[data[start]])
        while len(cut):
            start[cut] += 1
            cut = cut[start[cut] < end[cut]]
            cut = cut[trim[data[start[cut]]]]
        some = start < end
        start, end = start[some], end[some]
        cut = np.flatnonzero(trim[data[end - 1]])
        while len(cut):
            end[cut] -= 1
            cut = cut[trim[data[end[cut] - 1]]]
    bounds = np.searchsorted(start, offsets)
    return Words(bounds, start, end, _hashes(data, start, end, lower))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for each `length` neighbours, whatever text they are in."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total = mix(total * _ODD + hashes[k : k + n] + _U(k + 1))
    return total


def shingles(found: Words, size: int) -> list[np.ndarray]:
    """Per text its distinct shingles in order of their hash.

    A text with fewer words than `size` has one shingle of all its words; one without
    words has none.
    """
    window = runs(found.hash, size)
    sets = []
    for lo, hi in zip(found.bounds[:-1], found.bounds[1:]):
        n = int(hi - lo)
        if n >= size:
            own = np.sort(window[lo : hi - size + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            sets.append(own[new])
        else:
            sets.append(runs(found.hash[lo:hi], n) if n else window[:0])
    return sets
