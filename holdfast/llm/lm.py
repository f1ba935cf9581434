"""Scoring texts with a bigram model smoothed by deleted interpolation.

The probability of a word after its predecessor mixes three estimates: its share among the
words seen after the predecessor, its share among all words, and one over the vocabulary.
The weights depend on how often the predecessor was seen (buckets of powers of two) and are
learned by expectation-maximisation on held-out counts: each training token in turn is taken
out of the counts and predicted from the rest.

The work is cut into blocks of documents, written once. Each block asks for the counts of
its distinct words and word pairs, in packed lists by range of their hash; a range adds up
what all blocks know and answers each block. So a frequent word weighs one entry per block and
ranges stay small because their number grows with the corpus. A range that more than `fan`
blocks ask is added up by teams of blocks first, then over the teams, and answered the same
way back, so no task holds the entries of all blocks. Nothing but the histogram that the
weights are learned from (bounded by its bins) reaches the driver.

Cases: null texts are empty, and have their end as only token. Repeated rows each count. A
null id belongs to no held-out part unless the caller's column says so. Without training
tokens every token is unknown and has probability one over the vocabulary of one. Words and
pairs are identified by 64-bit hashes. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.text import buffers, mix, slices, words
from holdfast.session import cut_lineage

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
# Hashes of the end of a text and of the start before its first word.
END, START = _U(0x0E4D0E4D0E4D0E4D), _U(0x57A4757A4757A475)

# Bins of the held-out histogram: quarter octaves above the lowest estimate.
FINE, BINS, BUCKETS = 4, 256, 48


@dataclass(frozen=True)
class Model:
    """`block` tokens or so per block; `range_tokens` tokens of the corpus per hash range; some
    `fan` blocks per team where a range is asked by more.
    """

    block: int = 500_000
    range_tokens: int = 2_000_000
    fan: int = 4096
    rounds: int = 200


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    flat = pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True)
    planes = np.frombuffer(flat, np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=_U(0)))


def _unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(raw, n, "u8"), dtype=np.uint64)


# --- blocks

BLOCK = (
    "block bigint, n_docs int, n_tokens int, n_words int, docs binary, known binary, held binary,"
    " sizes binary, vocabulary binary, tokens binary"
)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by END, and how many each text has."""
    found = words(*buffers(texts), lower=True)
    n = np.diff(found.bounds)
    out = np.full(len(found.hash) + len(n), END, np.uint64)
    out[np.arange(len(found.hash)) + found.texts()] = found.hash
    return out, n + 1


def _blocks(how: Model):
    def blocks(batches):
        first = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def flush(number: int):
            docs, known, out, tokens, sizes = (np.concatenate(x) for x in zip(*held))
            vocabulary, at, often = np.unique(tokens, return_inverse=True, return_counts=True)
            # Frequent words get small numbers, which pack better.
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            row = {
                "block": first + number,
                "n_docs": len(docs),
                "n_tokens": len(tokens),
                "n_words": len(vocabulary),
                "docs": _pack(docs),
                "known": _pack(known),
                "held": _pack(out),
                "sizes": _pack(sizes.astype(np.int32)),
                "vocabulary": _pack(vocabulary[order]),
                "tokens": _pack(place[at]),
            }
            return pa.RecordBatch.from_pylist([row], schema=_schema(BLOCK))

        number, size = 0, 0
        for part in slices(batches, "text"):
            tokens, sizes = _tokens(part.column("text"))
            doc = part.column("doc")
            ids = doc.fill_null(0).to_numpy().astype(np.int64)
            flags = [np.array(c.to_pylist(), np.uint8) for c in (doc.is_valid(), part.column("out"))]
            held.append((ids, *flags, tokens, sizes))
            size += len(tokens)
            if size >= how.block:
                yield flush(number)
                number, size = number + 1, 0
                held.clear()
        if held:
            yield flush(number)

    return blocks


def _schema(fields: str) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(),
        "boolean": pa.bool_(),
    }
    pairs = (f.split() for f in fields.split(","))
    return pa.schema([(name, kinds[kind]) for name, kind in pairs])


class _Block:
    """One block: its tokens, and the distinct words and pairs it asks the counts of."""

    def __init__(self, row: dict):
        n, m, v = row["n_docs"], row["n_tokens"], row["n_words"]
        self.docs = _unpack(row["docs"], n, "i8")
        self.known = _unpack(row["known"], n, "u1").astype(bool)
        self.held = _unpack(row["held"], n, "u1").astype(bool)
        self.sizes = _unpack(row["sizes"], n, "i4").astype(np.int64)
        vocabulary = _unpack(row["vocabulary"], v, "u8")
        tokens = _unpack(row["tokens"], m, "i4").astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.training = np.repeat(~self.held, self.sizes)
        # Word number v stands for the start.
        before = np.empty(m, np.int64)
        before[1:] = tokens[:-1]
        before[self.starts] = v
        hashes = np.append(vocabulary, START)
        pair, at = np.unique(before * v + tokens, return_inverse=True)
        pair_hash = mix(hashes[pair // v] * _ODD + mix(hashes[pair % v]))
        self.word_keys, word_place = self._ordered(hashes[:-1])
        self.pair_keys, pair_place = self._ordered(pair_hash)
        self.words = word_place[tokens]
        self.pairs = pair_place[at]
        self.opening = before == v
        self.before = word_place[np.where(self.opening, 0, before)]

    @staticmethod
    def _ordered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes in order, and where each went."""
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return hashes[order], place

    def asked(self):
        """(kind, keys in order, how often each occurs in training texts)."""
        for kind, keys, at in ((1, self.word_keys, self.words), (2, self.pair_keys, self.pairs)):
            yield kind, keys, np.bincount(at[self.training], minlength=len(keys))


# --- counts

ASKED = "kind int, part int, block bigint, n int, keys binary, counts binary"
ANSWER = "kind int, part int, block bigint, n int, counts binary, types bigint, total bigint"


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each range of hashes begins among keys in order."""
    edges = [(i << 64) // parts for i in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]])


def _ask(parts: int):
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                out = []
                for kind, keys, counts in block.asked():
                    cuts = _cuts(keys, parts)
                    for part in np.flatnonzero(np.diff(cuts)):
                        own = slice(cuts[part], cuts[part + 1])
                        out.append(
                            {
                                "kind": kind,
                                "part": int(part),
                                "block": row["block"],
                                "n": int(cuts[part + 1] - cuts[part]),
                                "keys": _pack_sorted(keys[own]),
                                "counts": _pack(counts[own].astype(np.uint32)),
                            }
                        )
                yield pa.RecordBatch.from_pylist(out, schema=_schema(ASKED))

    return ask


def _listed(rows: list[dict], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of some entries in order, their summed counts, and where each key went."""
    keys = np.concatenate([_unpack_sorted(r["keys"], r["n"]) for r in rows])
    counts = np.concatenate([_unpack(r["counts"], r["n"], kind) for r in rows]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    new = np.diff(keys[order], prepend=~keys[order[:1]]) != 0
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return keys[order][new], np.add.reduceat(counts[order], np.flatnonzero(new)), at


def _replies(rows: list[dict], every: np.ndarray, types: int, total: int) -> pa.Table:
    """The counts `every` cut into one answer per entry; the first carries the range's sums."""
    out, at = [], 0
    for r in rows:
        own = {name: r[name] for name in ("kind", "part", "block", "n")}
        sums = {"types": 0 if at else types, "total": 0 if at else total}
        out.append(own | sums | {"counts": _pack(every[at : at + r["n"]])})
        at += r["n"]
    return pa.Table.from_pylist(out, schema=_schema(ANSWER))


def _answer(kind: str):
    """All counts of one range added up, and the answer to each entry."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        _, total, at = _listed(rows, kind)
        return _replies(rows, total[at], int((total > 0).sum()), int(total.sum()))

    return answer


def _team_sum(table: pa.Table) -> pa.Table:
    """One range's entries of a team of blocks as one entry, in the team's name."""
    rows = table.to_pylist()
    keys, counts, _ = _listed(rows, "u4")
    one = {
        "kind": rows[0]["kind"],
        "part": rows[0]["part"],
        "block": rows[0]["team"],
        "n": len(keys),
        "keys": _pack_sorted(keys),
        "counts": _pack(counts),
    }
    return pa.Table.from_pylist([one], schema=_schema(ASKED))


def _team_answer(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """The answer to a team handed on to its blocks."""
    rows, said = asked.to_pylist(), answers.to_pylist()[0]
    _, _, at = _listed(rows, "u4")
    counts = _unpack(said["counts"], said["n"], "i8")
    return _replies(rows, counts[at], said["types"], said["total"])


def _answers(blocks: DataFrame, parts: int, how: Model) -> DataFrame:
    """Each block's answers, one for each range that it asks."""
    asked = blocks.mapInArrow(_ask(parts), ASKED)
    teams = -(-blocks.count() // how.fan)
    if teams <= 1:
        return cut_lineage(asked.groupBy("kind", "part").applyInArrow(_answer("u4"), ANSWER))
    team = F.pmod(F.xxhash64("block"), F.lit(teams)).cast("bigint")
    asked = cut_lineage(asked.withColumn("team", team))
    asking = asked.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"))
    # A busy range meets its entries team by team.
    busy = asking.where(F.col("n") > how.fan).select(
        "kind", "part", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))).cast("bigint").alias("team")
    )
    busy = cut_lineage(busy)
    key = ["kind", "part", "team"]
    calm = asked.join(busy, key, "left_anti").drop("team")
    calm = calm.groupBy("kind", "part").applyInArrow(_answer("u4"), ANSWER)
    asked = asked.join(busy, key, "left_semi")
    sums = cut_lineage(asked.groupBy(*key).applyInArrow(_team_sum, ASKED))
    said = sums.groupBy("kind", "part").applyInArrow(_answer("i8"), ANSWER)
    said = said.withColumnRenamed("block", "team")
    told = asked.groupBy(*key).cogroup(said.groupBy(*key)).applyInArrow(_team_answer, ANSWER)
    return cut_lineage(calm.unionByName(told))


def _counted(block: _Block, answers: pa.Table, opened: int):
    """Training counts of each token, its pair and its predecessor."""
    rows = sorted(answers.to_pylist(), key=lambda r: (r["kind"], r["part"]))
    every = {1: [], 2: []}
    for r in rows:
        every[r["kind"]].append(_unpack(r["counts"], r["n"], "i8"))
    of_words, of_pairs = np.concatenate(every[1]), np.concatenate(every[2])
    before = np.where(block.opening, opened, of_words[block.before])
    return of_words[block.words], of_pairs[block.pairs], before


def _bucket(seen: np.ndarray) -> np.ndarray:
    """0 for a predecessor never seen, then one bucket per power of two."""
    return np.minimum(np.frexp(seen.astype(float))[1], BUCKETS - 1)


def _histogram(total: int, types: int, opened: int):
    """Held-out events of a block: each training token predicted without itself."""

    def histogram(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        cells = []
        for row in blocks.to_pylist():
            block = _Block(row)
            word, pair, before = (
                x[block.training] - 1 for x in _counted(block, answers, opened)
            )
            scale = types + 1
            share = np.divide(pair, before, out=np.zeros(len(pair)), where=before > 0)
            cells.append(
                (_bucket(before) * BINS + _bin(share * scale)) * BINS
                + _bin(word / max(total - 1, 1) * scale)
            )
        cell, n = np.unique(np.concatenate([np.zeros(0, np.int64), *cells]), return_counts=True)
        return pa.table({"cell": cell.astype(np.int64), "n": n.astype(np.int64)})

    return histogram


def _bin(ratio: np.ndarray) -> np.ndarray:
    """0 for none, else quarter octaves around 1 (the estimate one over the vocabulary)."""
    with np.errstate(divide="ignore"):
        octave = np.rint(FINE * np.log2(ratio)) + BINS // 2
    return np.where(ratio > 0, np.clip(octave, 1, BINS - 1), 0).astype(np.int64)


def _ratio(bins: np.ndarray) -> np.ndarray:
    return np.where(bins > 0, 2.0 ** ((bins - BINS // 2) / FINE), 0.0)


def mixture_weights(cell: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
    """Weights (buckets x pair, word, vocabulary) that make the held-out events most likely.

    A bucket without events takes the weights of all events together. One event more is
    spread over the three, so that no weight is 0.
    """
    bucket, pair, word = cell // BINS // BINS, cell // BINS % BINS, cell % BINS
    estimates = np.stack([_ratio(pair), _ratio(word), np.ones(len(cell))], axis=1)

    def learned(pick: np.ndarray) -> np.ndarray:
        weights = np.full(3, 1 / 3)
        for _ in range(rounds if pick.any() else 0):
            parts = estimates[pick] * weights
            parts *= (n[pick] / parts.sum(axis=1))[:, None]
            gained = parts.sum(axis=0) + 1 / 3
            gained /= gained.sum()
            if np.abs(gained - weights).max() < 1e-10:
                break
            weights = gained
        return weights

    pooled = learned(np.ones(len(cell), bool))
    every = [learned(bucket == b) if (bucket == b).any() else pooled for b in range(BUCKETS)]
    return np.array(every)


SCORED = (
    "doc bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
)


def _score(total: int, types: int, opened: int, weights: np.ndarray):
    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for row in blocks.to_pylist():
            block = _Block(row)
            word, pair, before = _counted(block, answers, opened)
            base = np.log10((word + 0.5) / (total + 0.5 * (types + 1)))
            mixed = weights[_bucket(before)]
            share = np.divide(pair, before, out=np.zeros(len(pair)), where=before > 0)
            likely = mixed[:, 0] * share + mixed[:, 1] * word / max(total, 1)
            likely += mixed[:, 2] / (types + 1)
            sums = [
                np.add.reduceat(x, block.starts)
                for x in ((word > 0).astype(np.int64), base, np.log10(likely))
            ]
            columns = [pa.array(block.docs, mask=~block.known), pa.array(block.held)]
            columns += [pa.array(block.sizes), *map(pa.array, sums)]
            tables.append(pa.Table.from_arrays(columns, schema=_schema(SCORED)))
        return pa.concat_tables(tables) if tables else _schema(SCORED).empty_table()

    return score


def scores(
    docs: DataFrame,
    held_out: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    how: Model = Model(),
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    The model learns from the rows that `held_out` (true or not) leaves. Both scores are
    base-10 logarithms of the text's probability; the base score is that of single words
    with half a count added.
    """
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc"),
        F.coalesce(held_out, F.lit(False)).alias("out"),
        F.col(text_column).alias("text"),
    )
    blocks = cut_lineage(rows.mapInArrow(_blocks(how), BLOCK))
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    parts = 1 + tokens // how.range_tokens
    answers = _answers(blocks, parts, how)
    known = answers.where("kind = 1").agg(F.sum("types"), F.sum("total")).first()
    types, total = known[0] or 0, known[1] or 0
    opened = rows.where(~F.col("out")).count()

    answers = answers.select("block", "kind", "part", "n", "counts")
    both = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    cells = (
        both.applyInArrow(_histogram(total, types, opened), "cell bigint, n bigint")
        .groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    weights = mixture_weights(cells["cell"].to_numpy(), cells["n"].to_numpy(), how.rounds)
    scored = both.applyInArrow(_score(total, types, opened, weights), SCORED)
    return scored.select(
        F.col("doc").alias(id_column),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
