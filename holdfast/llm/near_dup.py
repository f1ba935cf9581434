"""Near-duplicate texts: DartMinHash signatures, banded joining and exact checks.

Each element of a text's weighted set owns a region as wide as its weight. Hashed darts hit
the region at random times, at a rate equal to its width; each dart also names one of
`coordinates` slots, and the earliest dart in a slot is the text's signature there. Two
texts agree in a slot with a probability equal to their weighted Jaccard similarity.
A text needs some k ln k darts in all, however many elements it has.

Cases: null and empty texts and texts without words have no shingles, are compared with
nothing and stay classes of their own. Texts with fewer words than a shingle have one
shingle of all their words. Equal texts are always one class, repeated rows too. A null id
counts as larger than all others. Columns other than id and text are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm import graph
from holdfast.llm.text import WORD, buffers, mix, runs, shingles, slices, words
from holdfast.session import cut_lineage

# Bits of the sketch that tells sets with many differences apart.
ODD_BITS = 2048

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_SLOT = _U(0xC2B2AE3D27D4EB4F)
_SIDE = _U(0x165667B19E3779F9)


@dataclass(frozen=True)
class NearDup:
    """`words` per shingle; texts at or above `similarity` are linked.

    At similarity 0.8 a pair shares no band with probability
    (1 - 0.8**rows)**bands = 3e-6 for the defaults. `weight` is "count" (a shingle weighs as
    often as it occurs: weighted Jaccard) or "set" (each distinct shingle weighs one). Each
    bucket first compares one member with the rest. The texts of buckets that are not connected
    by that are joined exactly, by prefix filtering, so none of their links is lost. An element
    that many of these texts have is joined in slices of some `slice` texts.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 5
    weight: str = "count"
    slice: int = 512


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


def dart_minhash(
    elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, coordinates: int
) -> np.ndarray:
    """Signatures (one row per set) of weighted sets that lie one after the other.

    Set i has `elements[bounds[i]:bounds[i + 1]]`; an empty set gets zeros.
    """
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    mass = np.zeros(n)
    np.add.at(mass, owner, weights)
    cells = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), cells)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    cell = mix(elements[at] + layer.astype(np.uint64) * _SIDE)
    width = np.minimum(1.0, weights[at] - layer)
    owner = owner[at]

    first = np.full(n * coordinates, np.inf)
    won = np.zeros(n * coordinates, np.uint64)
    until = coordinates * (math.log(coordinates) + 2) / np.maximum(mass, 1e-300)
    partial = bool((width < 1).any())
    live = np.ones(len(cell), bool)
    while live.any():
        at, who, wide = cell[live], owner[live], width[live]
        time, throw = np.zeros(len(at)), 0
        while len(at):
            # Few cells left: several throws for each at once.
            many = max(1, min(64, 65536 // len(at)))
            turn = np.arange(throw + 1, throw + many + 1, dtype=np.uint64) * _STEP
            dart = mix(at[:, None] + turn)
            spell = -np.log1p(-_unit(dart))
            spell[:, 0] += time
            when = np.cumsum(spell, axis=1)
            hit = when <= until[who][:, None]
            if partial:
                inside = hit & (_unit(mix(dart ^ _SIDE)) < wide[:, None])
            else:
                inside = hit
            thrown, early = dart[inside], when[inside]
            slot = ((thrown ^ (thrown >> _U(29))) * _SLOT) >> _U(32)
            slot = ((slot * _U(coordinates)) >> _U(32)).astype(np.int64)
            slot += np.repeat(who * coordinates, inside.sum(axis=1))
            np.minimum.at(first, slot, early)
            best = early == first[slot]
            won[slot[best]] = thrown[best]
            keep = hit[:, -1]
            at, who, wide, time = at[keep], who[keep], wide[keep], when[keep, -1]
            throw += many
        # Sets with a slot that no dart has hit yet get twice the time.
        short = np.isinf(first.reshape(n, coordinates)).any(axis=1)
        live = short[owner]
        until[short] *= 2
    return won.reshape(n, coordinates)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]) * _SIDE
    for r in range(rows):
        keys = mix(keys * _STEP + parts[:, :, r])
    return keys.view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _counted(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of one text and how often each occurs."""
    if not len(hashes):
        return hashes, np.zeros(0)
    shingle, n = np.unique(runs(hashes, min(size, len(hashes))), return_counts=True)
    return shingle, n.astype(float)


def _weighted(found, how: NearDup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements, weights and bounds of the shingle sets of some texts."""
    if how.weight == "set":
        sets = shingles(found, how.words)
        weights = [np.ones(len(s)) for s in sets]
    else:
        spans = zip(found.bounds[:-1], found.bounds[1:])
        sets, weights = zip(*(_counted(found.hash[lo:hi], how.words) for lo, hi in spans))
    sizes = [len(s) for s in sets]
    return np.concatenate(sets), np.concatenate(weights), np.cumsum([0, *sizes])


def _sign(how: NearDup):
    def sign(batches):
        for part in slices(batches, "text"):
            found = words(*buffers(part.column("text")))
            elements, weights, bounds = _weighted(found, how)
            signed = dart_minhash(elements, weights, bounds, how.bands * how.rows)
            keys = band_keys(signed, how.bands, how.rows)
            mass = np.add.reduceat(np.append(weights, 0.0), bounds[:-1]) * (np.diff(bounds) > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc"),
                    part.column("node"),
                    pa.array(mass),
                    _lists(keys.ravel(), np.full(len(keys), how.bands)),
                ],
                ["doc", "node", "mass", "keys"],
            )

    return sign


def _sets(how: NearDup):
    """Elements for the exact check: a shingle with weight n stands for n elements.

    `odd` has a bit per hash value, set if an odd number of elements has it.
    """

    def sets(batches):
        for part in slices(batches, "text"):
            found = words(*buffers(part.column("text")))
            elements, weights, bounds = _weighted(found, how)
            n = weights.astype(np.int64)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            sizes = np.bincount(owner, weights=weights, minlength=len(bounds) - 1)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            each = np.where(
                nth == 0, np.repeat(elements, n), mix(np.repeat(elements, n) + nth.astype(_U) * _SIDE)
            )
            sizes = sizes.astype(np.int64)
            who = np.repeat(np.arange(len(sizes)), sizes)
            odd = np.zeros((len(sizes), ODD_BITS), np.uint8)
            np.bitwise_xor.at(odd, (who, (mix(each ^ _SLOT) % _U(ODD_BITS)).astype(np.int64)), 1)
            packed = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("node"),
                    _lists(each.view(np.int64), sizes),
                    _lists(packed.ravel(), np.full(len(sizes), packed.shape[1])),
                ],
                ["node", "shingles", "odd"],
            )

    return sets


def _linked(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """The pairs (a, b) whose exact similarity is high enough."""
    own = F.struct("mass", "shingles")
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), own.alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), own.alias("y")), "b")
        .withColumn("common", F.size(F.array_intersect("x.shingles", "y.shingles")))
    )
    total = F.col("x.mass") + F.col("y.mass") - F.col("common")
    return both.where(F.col("common") >= how.similarity * total - 1e-9).select("a", "b")


def _may_match(how: NearDup):
    """Whether sets with masses `ma`, `mb` and sketches `oa`, `ob` can be similar enough.

    Sets of similarity t differ in (1 - t) / (1 + t) of their summed masses at most, and their
    sketches differ in no more bits than the sets in elements: no similar pair is lost.
    """
    t = how.similarity
    differ = F.expr("aggregate(zip_with(oa, ob, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n)")
    return (F.least("ma", "mb") >= t * F.greatest("ma", "mb") - 1e-9) & (
        differ <= (1 - t) / (1 + t) * (F.col("ma") + F.col("mb")) + 1e-9
    )


def _alike(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Without the pairs whose masses or sketches rule out the similarity."""
    facts = sets.select("node", "mass", "odd")
    return (
        pairs.join(facts.withColumnsRenamed({"node": "a", "mass": "ma", "odd": "oa"}), "a")
        .join(facts.withColumnsRenamed({"node": "b", "mass": "mb", "odd": "ob"}), "b")
        .where(_may_match(how))
        .select("a", "b")
    )


def _missed(nodes: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Pairs (a, b) in different parts of `nodes` (node, part) that may be similar: all that are.

    Prefix filtering: elements are ordered by how many of the sets have them, rare ones
    first. Of two sets that are similar enough, the larger has one of the smaller's first
    few elements among its own first few. Elements that one set alone has come first and
    match nothing, so an edited copy is compared with those texts only that share its edits.
    The larger sets of a frequent element are spread over slices, each of which meets all of the
    smaller ones, so that no task compares a family with itself alone.
    """
    t = how.similarity
    own = sets.join(nodes, "node")
    terms = own.select("node", F.explode("shingles").alias("term"))
    often = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(terms.join(often, "term"))
    lone = shared.groupBy("node").agg(F.count(F.lit(1)).alias("some"))
    facts = own.select("node", "part", "mass", "odd").join(lone, "node")
    alone = F.col("mass") - F.col("some")
    # Common elements needed: of a set with any similar one, and with one at least as large.
    facts = facts.select(
        "node",
        "part",
        "mass",
        "odd",
        (F.col("mass") - F.ceil(t * F.col("mass") - 1e-9) + 1 - alone).alias("wide"),
        (F.col("mass") - F.ceil(2 * t / (1 + t) * F.col("mass") - 1e-9) + 1 - alone).alias("narrow"),
    )
    order = Window.partitionBy("node").orderBy("n", "term")
    first = cut_lineage(
        shared.join(facts.where("wide > 0"), "node")
        .withColumn("rank", F.row_number().over(order))
        .where("rank <= wide")
        .withColumn("near", F.col("rank") <= F.col("narrow"))
        .withColumn("slices", F.ceil(F.col("n") / how.slice))
        .select("term", "node", "part", "mass", "odd", "near", "slices")
    )
    names = {"node": "a", "part": "pa", "mass": "ma", "odd": "oa", "term": "of"}
    every = F.explode(F.sequence(F.lit(1), "slices"))
    small = first.where("near").withColumn("to", every).withColumnsRenamed(names)
    names = {"node": "b", "part": "pb", "mass": "mb", "odd": "ob"}
    at = F.pmod(F.xxhash64("node"), "slices") + 1
    large = first.withColumn("at", at).withColumnsRenamed(names)
    fits = (F.col("pa") != F.col("pb")) & (F.col("ma") <= F.col("mb")) & _may_match(how)
    same = (F.col("of") == F.col("term")) & (F.col("to") == F.col("at"))
    met = small.drop("near", "slices").join(large.drop("near", "slices"), same & fits)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Id, text and the hash that stands for the text; null for a text without words."""
    return docs.select(
        F.col(id_column).cast("bigint").alias("doc"), F.col(text_column).alias("text")
    ).withColumn("node", _node("text"))


def _node(column: str):
    return F.when(F.col(column).rlike(WORD), F.xxhash64(column))


def _classes(rows: DataFrame, how: NearDup) -> DataFrame:
    """(node, doc, part, class_id, n_links) per text: its smallest id, its class, its links.

    `part` tells classes apart (the smallest node in it); ids may be null or clash.
    """
    signed = rows.where("node is not null").mapInArrow(
        _sign(how), "doc bigint, node bigint, mass double, keys array<bigint>"
    )
    texts = cut_lineage(
        signed.groupBy("node").agg(
            F.min("doc").alias("doc"), F.first("mass").alias("mass"), F.first("keys").alias("keys")
        )
    )
    entries = texts.select("node", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut_lineage(entries.join(shared, "key"))
    # Of a family of copies the original meets most others, so it leads its buckets.
    often = met.groupBy("node").agg(F.sum("n").alias("weight"))
    members = cut_lineage(met.join(often, "node"))
    leads = members.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("lead"))
    stars = (
        members.join(leads, "key")
        .where("node != lead")
        .select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
    )
    wanted = members.select("node").distinct().join(texts.select("node", "doc"), "node")
    wanted = wanted.withColumnsRenamed({"node": "of", "doc": "least"})
    # Of equal texts the row with the smallest id is read, repeated rows once. The id is a key
    # of the join, so that the copies of one text do not meet in one task.
    own = (F.col("node") == F.col("of")) & F.col("doc").eqNullSafe(F.col("least"))
    source = rows.join(wanted, own, "left_semi").select("node", "text")
    fields = "node bigint, shingles array<bigint>, odd array<bigint>"
    sets = source.mapInArrow(_sets(how), fields)
    sets = cut_lineage(sets.dropDuplicates(["node"]).join(texts.select("node", "mass"), "node"))

    pairs = cut_lineage(stars.distinct())
    links = cut_lineage(_linked(_alike(pairs, sets, how), sets, how))
    parts = cut_lineage(members.select(graph.NODE).distinct().withColumn("part", F.col("node")))
    parts = graph.merge(parts, links)
    # Buckets whose members are not all connected by now.
    held = members.join(parts, "node")
    mixed = held.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"))
    mixed = held.join(mixed.where("p != q").select("key"), "key").select("node", "part").distinct()
    rest = _missed(cut_lineage(mixed), sets, how).join(pairs, ["a", "b"], "left_anti")
    more = cut_lineage(_linked(rest, sets, how))
    parts = graph.merge(parts, more)
    every = links.unionByName(more)
    degree = (
        every.select(F.explode(F.array("a", "b")).alias("node"))
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("n_links"))
    )
    near = parts.join(texts.select("node", "doc"), "node").join(degree, "node", "left")
    label = near.groupBy("part").agg(F.min("doc").alias("least"))
    near = near.join(label, "part").select("node", "part", "least", "n_links")
    return (
        texts.select("node", "doc")
        .join(near, "node", "left")
        .select(
            "node",
            "doc",
            F.coalesce("part", "node").alias("part"),
            F.coalesce("least", "doc").alias("class_id"),
            "n_links",
        )
    )


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", how: NearDup = NearDup()
) -> DataFrame:
    """(doc_id, class_id, class_size, n_links) for every row of `docs`.

    `class_id` is the smallest id in the class (null if all its ids are; classes whose ids
    clash share one, but are sized apart), `n_links` the number of checked links of the
    row's text to other texts (texts that are connected already are not compared again).
    Texts are identified by a 64-bit hash.
    """
    rows = _rows(docs, id_column, text_column)
    classes = _classes(rows, how).drop("doc")
    counts = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    known = classes.join(counts, "node")
    sizes = known.groupBy("part").agg(F.sum("n").alias("class_size"))
    known = known.join(sizes, "part").drop("part", "n")
    return (
        rows.drop("text")
        .join(known, "node", "left")
        .select(
            F.col("doc").alias(id_column),
            F.coalesce("class_id", "doc").alias("class_id"),
            F.coalesce("class_size", F.lit(1)).alias("class_size"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )


def one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", how: NearDup = NearDup()
) -> DataFrame:
    """The rows of `docs` with one row for each class: that of the smallest id, once."""
    classes = _classes(_rows(docs, id_column, text_column), how)
    # Null ids come last.
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "node")
    first = classes.groupBy("part").agg(F.min(order).alias("first"))
    first = first.select(F.col("first.node").alias("of"), F.col("first.doc").alias("least"))
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_column).cast("bigint").alias("doc"),
        _node(text_column).alias("node"),
    )
    own = (F.col("node") == F.col("of")) & F.col("doc").eqNullSafe(F.col("least"))
    kept = packed.join(first, own, "left_semi").dropDuplicates(["node"])
    return kept.select("row.*").unionByName(packed.where("node is null").select("row.*"))
