"""Benchmark passages in documents, also with other numbers, names and units.

Words lose the punctuation at their ends and their case. Numbers, units and names (words
with a capital inside a sentence) become typed placeholders, whose original words are the
slots. Whether a capital is a name depends on the words around it, so each text has three
kinds of template: names inside sentences; every capital word but function words a name; and
plain words without placeholders, which are the same in a copy of any case, wrapping or
place. Documents and benchmark items are cut into windows of these templates; equal windows
of a kind are found by a hash join. Windows of one item and kind that lie in a document at
the same distance form an alignment. It counts as a whole if its slots are filled
consistently, that is if equal slot words of the item always became equal words; otherwise
only its windows with the item's own words count. The kinds together cover an item.

Cases: null and empty texts have no windows. Items with fewer than `shortest` words are too
short to tell and match nothing; those shorter than a window match as a whole. Windows with
fewer than `fixed` words besides placeholders match with their own words only. Very long texts are
read whole. Rows with equal id and text are reported once. Null ids are kept. Items with equal
or missing ids but different texts are items of their own; equal items of one id are one. Empty
tables on either side give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.bloom import bloom_filter
from holdfast.llm.text import buffers, mix, runs, slices, words

# English number words and units of measure that become placeholders.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty "
    "fifty hundred thousand million"
).split()
UNITS = (
    "mm cm m km mg g kg ms s min h hour hours minute minutes second seconds day days week weeks "
    "month months year years inch inches foot feet yard yards mile miles liter liters litre "
    "litres ml gram grams kilogram kilograms meter meters metre metres kilometer kilometers "
    "kilometre kilometres percent dollar dollars euro euros cent cents mph kmh"
).split()
# Words that are no names although they often open a sentence.
FUNCTION = (
    "a an the this that these those i he she it we you they his her its our your their my what "
    "which who whom whose when where why how is are was were be been do does did has have had can "
    "could will would shall should may might must if in on at by for from of to with as into over "
    "under after before during while and or but not no so then there here all any each every some "
    "both let find calculate compute solve suppose given consider write explain describe choose"
).split()

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(string.punctuation.encode())] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(string.digits.encode())] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[list(string.ascii_uppercase.encode())] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\n")] = True
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0xA1, 0xA2, 0xA3))


@dataclass(frozen=True)
class Decontaminate:
    """`window` words per template window; a document is reported for an item if it covers
    `enough` words of it, or the share `share` of a shorter item. Window hashes of the
    benchmark are sent to all tasks while they number at most `sent` (8 bytes each); beyond
    that a Bloom filter of them is sent instead, of 2 bytes each and at most `filter_bytes`
    in all. Only windows of the documents that pass are shuffled to the join.
    """

    window: int = 8
    shortest: int = 5
    fixed: int = 4
    enough: int = 13
    share: float = 0.7
    sent: int = 1_000_000
    filter_bytes: int = 1 << 26


def _of(vocabulary: list[str]) -> np.ndarray:
    return np.sort(words(*buffers(pa.array(vocabulary))).hash)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def templates(texts: pa.Array):
    """Words of the texts, and per kind the template hashes and which are placeholders."""
    data, offsets = buffers(texts)
    found = words(data, offsets, lower=True, trim=_PUNCTUATION)
    plain = found.hash, np.zeros(len(found.hash), bool)
    if not len(found.hash):
        return found, [plain] * 3
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = (digits[found.end] > digits[found.start]) | _among(found.hash, _of(NUMBERS))
    unit = _among(found.hash, _of(UNITS))
    capital = _CAPITAL[data[found.start]]
    second = np.minimum(found.start + 1, len(data) - 1)
    capital &= ~(_CAPITAL[data[second]] & (found.start + 1 < found.end))
    # A capital at the start of a text, line or sentence may or may not be a sign of a name.
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    since = np.concatenate([[0], found.end[:-1]])
    opening = stops[found.start] > stops[since]
    opening[found.bounds[:-1][np.diff(found.bounds) > 0]] = True
    kinds = []
    for name in (capital & ~opening, capital & ~_among(found.hash, _of(FUNCTION))):
        template, slot = found.hash.copy(), name | unit | number
        for kind, code in ((name, _NAME), (unit, _UNIT), (number, _NUMBER)):
            template[kind] = code
        kinds.append((template, slot))
    return found, [*kinds, plain]


def _rows(ids: list, found, at: np.ndarray, hashes: np.ndarray, length: int, part, kind=None):
    """One row per window at word `at`, with the id, place and words of each; `kind` for items."""
    text = np.searchsorted(found.bounds, at, "right") - 1
    # Empty texts share their bound with the next one; the last of equals owns the word.
    inside = at[:, None] + np.arange(length)
    slots = pa.ListArray.from_arrays(
        pa.array(np.arange(len(at) + 1, dtype=np.int32) * length),
        pa.array(found.hash[inside].ravel().view(np.int64)),
    )
    columns = [part.column(c).take(pa.array(text)) for c in ids]
    columns += [
        pa.array((at - found.bounds[text]).astype(np.int32)),
        pa.array(hashes.view(np.int64)),
        slots,
    ]
    if kind is not None:
        columns.append(pa.array(np.full(len(at), kind, np.int32)))
        columns.append(pa.array(np.diff(found.bounds)[text].astype(np.int32)))
    return columns


def _salted(hashes: np.ndarray, length: int, kind: int) -> np.ndarray:
    """Windows of different lengths or kinds are never equal."""
    return mix(hashes ^ np.uint64(length + 1000 * kind))


def _item_windows(how: Decontaminate):
    names = ["item", "item_hash", "place", "hash", "slots", "kind", "total"]

    def windows(batches):
        for part in slices(batches, "text"):
            found, kinds = templates(part.column("text"))
            sizes = np.diff(found.bounds)
            for length in range(min(how.shortest, how.window), how.window + 1):
                whole = sizes == length if length < how.window else sizes >= length
                first = np.concatenate(
                    [np.zeros(0, np.int64)]
                    + [
                        np.arange(lo, hi - length + 1)
                        for lo, hi, fit in zip(found.bounds[:-1], found.bounds[1:], whole)
                        if fit
                    ]
                )
                for kind, (template, slot) in enumerate(kinds):
                    hashes = _salted(runs(template, length), length, kind)
                    # Plain windows have no placeholders: all of them are kept.
                    taken = np.concatenate([[0], np.cumsum(~slot)])
                    at = first[taken[first + length] - taken[first] >= min(how.fixed, length)]
                    if len(at):
                        columns = _rows(
                            ["item", "item_hash"], found, at, hashes[at], length, part, kind
                        )
                        yield pa.RecordBatch.from_arrays(columns, names)

    return windows


# Ids may be missing or shared, so items are told apart by their texts as well.
OF_ITEM = ["item", "item_hash", "total"]


def _doc_windows(lengths: list[int], known, exact: bool):
    """Windows that the broadcast `known` holds: sorted hashes if `exact`, else a filter."""
    names = ["doc", "text_hash", "place", "hash", "slots"]

    def windows(batches):
        sent = known.value
        holds = (lambda hashes: _among(hashes, sent)) if exact else sent.holds
        for part in slices(batches, "text"):
            found, kinds = templates(part.column("text"))
            owner = found.texts()
            for length in lengths:
                for kind, (template, _) in enumerate(kinds):
                    hashes = _salted(runs(template, length), length, kind)
                    at = np.flatnonzero(owner[: len(hashes)] == owner[length - 1 :])
                    at = at[holds(hashes[at])]
                    if len(at):
                        ids = ["doc", "text_hash"]
                        columns = _rows(ids, found, at, hashes[at], length, part)
                        yield pa.RecordBatch.from_arrays(columns, names)

    return windows


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    how: Decontaminate = Decontaminate(),
) -> DataFrame:
    """(doc_id, item_id, text_hash, n_words, n_covered, exact) per document and item in it.

    `n_words` are the item's, `n_covered` those found in the document, `exact` says that all
    counted windows have the item's own words. `text_hash` is xxhash64 of the text.
    """
    spark = docs.sparkSession
    items = (
        benchmark.select(
            F.col(item_column).alias("item"),
            F.xxhash64(item_text).alias("item_hash"),
            F.col(item_text).alias("text"),
        )
        .where("text is not null")
        .mapInArrow(
            _item_windows(how),
            "item bigint, item_hash bigint, place int, hash bigint, slots array<bigint>, kind int,"
            " total int",
        )
        .distinct()
    )
    kinds = items.groupBy(F.size("slots").alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()
    lengths = sorted(r["n"] for r in kinds)
    n_windows = sum(r["rows"] for r in kinds)
    exact = n_windows <= how.sent
    if exact:
        rows = items.select("hash").distinct().toPandas()
        known = np.sort(rows["hash"].to_numpy(np.int64).view(np.uint64))
    else:
        known = bloom_filter(items, "hash", n_windows, how.filter_bytes)
    known = spark.sparkContext.broadcast(known)
    found = (
        docs.select(
            F.col(id_column).cast("bigint").alias("doc"),
            F.xxhash64(text_column).alias("text_hash"),
            F.col(text_column).alias("text"),
        )
        .where("text is not null")
        .mapInArrow(
            _doc_windows(lengths, known, exact),
            "doc bigint, text_hash bigint, place int, hash bigint, slots array<bigint>",
        )
    )
    pairs = found.withColumnsRenamed({"place": "there", "slots": "filled"}).join(items, "hash")
    # At most one row per window of the item, whatever the document repeats.
    aligned = (
        pairs.groupBy(
            "doc", "text_hash", *OF_ITEM, "kind", F.expr("there - place").alias("shift")
        )
        .agg(F.collect_set(F.struct("place", "slots", "filled")).alias("windows"))
        .withColumn(
            "fillings",
            F.expr(
                "array_distinct(flatten(transform(windows, w -> arrays_zip(w.slots, w.filled))))"
            ),
        )
        .withColumn(
            "consistent",
            F.expr("size(fillings) = size(array_distinct(transform(fillings, f -> f.slots)))"),
        )
        .withColumn(
            "counted", F.expr("filter(windows, w -> consistent or w.slots = w.filled)")
        )
    )
    covers = (
        "array_distinct(flatten(transform(flatten(collect_list(counted)), w ->"
        " sequence(w.place, w.place + size(w.slots) - 1))))"
    )
    own = "forall(flatten(collect_list(counted)), w -> w.slots = w.filled)"
    matched = (
        aligned.groupBy("doc", "text_hash", *OF_ITEM)
        .agg(F.size(F.expr(covers)).alias("n_covered"), F.expr(own).alias("exact"))
        .where(F.col("n_covered") >= F.least(F.lit(how.enough), F.ceil(how.share * F.col("total"))))
    )
    return matched.select(
        F.col("doc").alias("doc_id"),
        F.col("item").alias("item_id"),
        "text_hash",
        F.col("total").alias("n_words"),
        "n_covered",
        "exact",
    )
