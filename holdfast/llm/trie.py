"""Conversation prefix trie: a node per distinct sequence of first turns, with its statistics.

A prefix is known by a digest of 128 bits: the sum of hashes of its turns, each taken with its
depth, so that digests are running totals and a long conversation is summed in many tasks.
A count-min sketch of all digests (two rows of counters that stop at two, as bit maps) screens
them: an estimate of one proves that a prefix belongs to one conversation. Where it holds for a
prefix and for its parent, the node is complete as it stands and is emitted in place, without a
shuffle. Only the others are grouped exactly: prefixes that may be shared, and the first
one of each conversation that is not. The sketch has four counters per prefix and row, up to
`largest` (32 MB in all, which is what tasks receive); beyond that fewer prefixes are screened off,
and results stay the same.

What a subtree holds is not gathered from level to level: every node hands its weight
(leaves, saved code points) to its smallest conversation, running totals along that conversation
make sums of all deeper nodes of them, and each node adds up those of its members.

Cases: turns are ordered by turn, nulls first, ties by role, then by the first 32 characters
of the text, then by its digest. Null role and text are empty. Rows without a conversation id
belong to none and are left out. Repeated rows are turns of their own. Very long texts are
hashed where they are and never shuffled. An empty table has no node, not even a root.
Other columns are ignored, whatever their names. Two prefixes are taken for one only if
128 bits agree by chance.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.operators.ordered import CHUNK, Chunks, in_chunks, running_totals
from holdfast.session import cut_lineage

NODE, PARENT = ["node_a", "node_b"], ["parent_a", "parent_b"]
_WEIGHTS = ["w0", "w1", "w2", "w3"]
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Trie:
    """`per_prefix` counters per prefix and row of the sketch, at most `largest` (powers of
    two); ids that end at a node are digested in pieces of `piece`."""

    per_prefix: int = 4
    largest: int = 1 << 27
    piece: int = 1 << 16


def turns(
    rows: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> Chunks:
    """Chunks of (conv, a, b, chars, n): every turn's digest, code points and place from 0."""
    role = F.coalesce(F.col(role_column), F.lit(""))
    text = F.coalesce(F.col(text_column), F.lit(""))
    named = rows.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias("conv"),
        F.col(turn_column).alias("turn"),
        role.alias("role"),
        F.substring(text, 1, 32).alias("front"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.length(text).cast("bigint").alias("chars"),
    )
    keyed = named.select(
        "conv",
        F.struct("turn", "role", "front", "a", "b").alias("key"),
        "chars",
        F.lit(1).cast("bigint").alias("one"),
    )
    chunks = in_chunks(keyed, "key", ["conv"])
    placed = running_totals(chunks, "key", ["one"]).select(
        "conv", CHUNK, "key.a", "key.b", "chars", F.col("one_before").alias("n")
    )
    return Chunks(placed, chunks.by, chunks.groups)


def continued(own: Chunks, base: Column, many: Column, most: int) -> Chunks:
    """Conversations that begin with the first `many` turns of another one, and go on with their
    own turns after their first `many`; chunks of (conv, depth, a, b, chars, last).

    `base` and `many` are functions of `conv`; `many` is below `most`, so what another
    conversation lends is a short array. Every conversation also has a row for depth 0.
    """
    heads = (
        own.rows.where(F.col("n") < most - 1)
        .groupBy(F.col("conv").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("n", "a", "b", "chars"))).alias("head"))
    )
    sizes = own.rows.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    taken = F.coalesce(F.slice("head", 1, F.col("many").cast("int")), F.array())
    joined = (
        sizes.withColumns({"base": base, "many": many})
        .join(heads, "base", "left")
        .withColumn("head", F.when(F.col("many") > 0, taken).otherwise(F.slice("head", 1, 0)))
        .withColumn("taken", F.coalesce(F.when(F.size("head") > 0, F.size("head")), F.lit(0)))
    )
    known = cut_lineage(
        joined.select(
            "conv",
            "many",
            "head",
            "taken",
            (F.col("taken") + F.greatest(F.col("size") - F.col("many"), F.lit(0))).alias("length"),
        )
    )
    facts = (
        own.rows.select("conv", CHUNK)
        .distinct()
        .join(known.select("conv", "many", "taken", "length"), "conv")
    )
    depth = (F.col("n") - F.col("many") + F.col("taken") + 1).cast("bigint")
    later = (
        own.join(facts)
        .where(F.col("n") >= F.col("many"))
        .select("conv", CHUNK, depth.alias("depth"), "a", "b", "chars", "length")
    )
    lent = known.select("conv", "length", F.posexplode("head").alias("at", "t")).select(
        "conv",
        F.lit(-1).alias(CHUNK),
        (F.col("at") + 1).cast("bigint").alias("depth"),
        "t.a",
        "t.b",
        "t.chars",
        "length",
    )
    zero = F.lit(0).cast("bigint")
    roots = known.select(
        "conv", F.lit(-1).alias(CHUNK), zero.alias("depth"), F.lit(None).cast("bigint").alias("a"),
        F.lit(None).cast("bigint").alias("b"), zero.alias("chars"), "length",
    )
    last = (F.col("depth") == F.col("length")).alias("last")
    rows = later.unionByName(lent).unionByName(roots).withColumn("last", last).drop("length")
    return Chunks(rows, own.by, own.groups)


def _pieces(hashed: Column) -> list[Column]:
    return [F.shiftrightunsigned(hashed, 32), hashed.bitwiseAND(F.lit(_LOW))]


def _joined(high: str, low: str, plus: bool) -> Column:
    """Two totals modulo 2**32 as one number of 64 bits."""

    def part(name: str) -> Column:
        before = F.col(f"{name}_before")
        return (before + F.col(name) if plus else before).bitwiseAND(F.lit(_LOW))

    return F.shiftleft(part(high), 32).bitwiseOR(part(low))


def prefixes(chunks: Chunks) -> Chunks:
    """Chunks of (conv, depth, chars, last, node, parent): digests of every prefix."""
    weights = []
    for seed in (3, 4):
        weights += _pieces(F.xxhash64(F.lit(seed), "depth", "a", "b"))
    # The root's digest is 0.
    at = {w: F.when(F.col("depth") > 0, c).otherwise(0) for w, c in zip(_WEIGHTS, weights)}
    rows = cut_lineage(chunks.rows.withColumns(at).drop("a", "b"))
    summed = running_totals(Chunks(rows, chunks.by, chunks.groups), "depth", _WEIGHTS)
    pairs = list(zip(_WEIGHTS[::2], _WEIGHTS[1::2]))
    found = summed.select(
        "conv",
        CHUNK,
        "depth",
        "chars",
        "last",
        *(_joined(*pair, plus=True).alias(n) for pair, n in zip(pairs, NODE)),
        *(
            F.when(F.col("depth") > 0, _joined(*pair, plus=False)).alias(n)
            for pair, n in zip(pairs, PARENT)
        ),
    )
    return Chunks(cut_lineage(found), chunks.by, chunks.groups)


# --- count-min screening


_MAP = 1 << 15


def sketch(rows: DataFrame, how: Trie = Trie()) -> np.ndarray:
    """A bit per counter, two rows of them: whether it has counted two prefixes or more."""
    want = max(rows.count() * how.per_prefix, _MAP)
    size = min(1 << (want - 1).bit_length(), how.largest)
    cells = [F.col(n).bitwiseAND(F.lit(size - 1)) + i * size for i, n in enumerate(NODE)]
    full = (
        rows.where("depth > 0")
        .select(F.explode(F.array(*cells)).alias("cell"))
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .groupBy(F.shiftright("cell", 15).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit(_MAP - 1))).alias("bits"))
        .collect()
    )
    maps = np.zeros((2 * size // _MAP, _MAP // 8), np.uint8)
    for r in full:
        maps[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return maps.reshape(2, -1)


def _single(maps: np.ndarray, digests: list[np.ndarray]) -> np.ndarray:
    """Where the least of a prefix's counters is one."""
    size = maps.shape[1] * 8
    out = np.zeros(len(digests[0]), bool)
    for row, digest in zip(maps, digests):
        cell = digest & (size - 1)
        out |= (row[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 0
    return out


def screened(rows: DataFrame, maps: np.ndarray) -> DataFrame:
    """Prefixes with `single` (proved to be of one conversation) and `tail` (its parent too)."""
    sent = rows.sparkSession.sparkContext.broadcast(maps)

    def test(batches):
        for batch in batches:
            filled = [
                np.asarray(batch.column(n).fill_null(0), np.int64) for n in [*NODE, *PARENT]
            ]
            depth = np.asarray(batch.column("depth"), np.int64)
            single = _single(sent.value, filled[:2]) & (depth > 0)
            tail = single & _single(sent.value, filled[2:]) & (depth > 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(single), pa.array(tail)],
                [*batch.schema.names, "single", "tail"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(test, f"{fields}, single boolean, tail boolean")


# --- exact nodes


def _digest(ids: Column) -> Column:
    return F.sha2(ids.cast("string"), 256)


_NONE = hashlib.sha256(b"").hexdigest()


def _tails(rows: DataFrame) -> DataFrame:
    """Nodes of one conversation whose parents are of that one as well: complete as they are."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return rows.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("conv").alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(F.col("last"), zero).otherwise(one).alias("n_children"),
        one.alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(F.col("last"), _digest(F.col("conv"))).otherwise(_NONE).alias("ends_sha256"),
    )


def ends(rows: DataFrame, how: Trie = Trie()) -> DataFrame:
    """(node, ends_sha256) of the ids in (node, conv) rows, in numerical order.

    Ids are sorted by range chunks and joined by pieces of bounded length in many tasks.
    Only the nodes that have several pieces are hashed one piece after the other in a task, since a
    digest cannot be split; that task holds one piece at a time.
    """
    # Nothing is joined to these chunks, so the number of groups plays no part.
    chunks = in_chunks(rows.select(*NODE, "conv"), "conv", NODE, groups=1)
    numbered = chunks.rows.withColumn(
        "piece", F.floor((F.row_number().over(chunks.within("conv")) - 1) / how.piece)
    )
    joined = numbered.groupBy(*NODE, CHUNK, "piece").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ","
        ).alias("ids")
    )
    joined = cut_lineage(joined)
    parts = joined.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("parts"), F.max("ids").alias("ids")
    )
    short = parts.where("parts = 1").select(*NODE, _digest(F.col("ids")).alias("ends_sha256"))
    several = parts.where("parts > 1").select(*NODE)

    def stream(batches):
        key, state, out = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(n).to_pylist() for n in [*NODE, "ids"])):
                if key != (a, b):
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state is not None:
            out.append((*key, state.hexdigest()))
        if out:
            a, b, found = zip(*out)
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(found)]
            yield pa.RecordBatch.from_arrays(columns, [*NODE, "ends_sha256"])

    long = (
        joined.join(several, NODE, "left_semi")
        .repartition(*NODE)
        .sortWithinPartitions(*NODE, CHUNK, "piece")
        .select(*NODE, "ids")
        .mapInArrow(stream, "node_a bigint, node_b bigint, ends_sha256 string")
    )
    return short.unionByName(long)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's conversation; `nodes` is a written table.

    A node with a thousandth of all nodes as children is broadcast (there are at most a thousand
    of them), so that the shuffled join meets no such key.
    """
    least = nodes.count() / 1000
    of_parent = {n: p for n, p in zip(NODE, PARENT)} | {"conv_id": "parent_conv_id"}
    parents = nodes.select(*NODE, "conv_id", "n_children").withColumnsRenamed(of_parent)
    heavy = parents.where(F.col("n_children") >= least).drop("n_children")
    light = parents.where(F.col("n_children") < least).drop("n_children")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    others = nodes.where("depth > 0")
    near = others.join(F.broadcast(heavy), PARENT)
    far = others.join(F.broadcast(heavy), PARENT, "left_anti").join(light, PARENT)
    return root.unionByName(near).unionByName(far)


def nodes(found: Chunks, how: Trie = Trie()) -> DataFrame:
    """One row per node of the trie of `prefixes`; conv_id is its smallest member."""
    flagged = screened(found.rows, sketch(found.rows, how))
    tails = _tails(flagged.where("tail"))
    open_rows = in_chunks(
        flagged.where("not tail").drop("tail", CHUNK), "depth", ["conv"], groups=found.groups
    )

    # Below the first prefix that is proved single, a conversation is alone.
    first = open_rows.rows.where("single").groupBy("conv").agg(F.min("depth").alias("cut"))
    facts = open_rows.rows.select("conv", CHUNK).distinct().join(first, "conv", "left")
    limited = cut_lineage(open_rows.join(facts))
    below = F.coalesce(F.col("depth") > F.col("cut"), F.lit(False))
    more_tails = _tails(limited.where(below))
    shared = limited.where(~below).drop("cut")

    grouped = cut_lineage(
        shared.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("n_convs"),
            F.min("conv").alias("conv_id"),
            F.min("depth").alias("depth"),
            F.max("chars").alias("chars"),
            *(F.max(p).alias(p) for p in PARENT),
            F.bool_or("single").alias("single"),
            F.bool_or("last").alias("last"),
        )
    )
    children = (
        grouped.where("depth > 0")
        .groupBy(*(F.col(p).alias(n) for p, n in zip(PARENT, NODE)))
        .agg(F.count(F.lit(1)).alias("children"))
    )
    counted = grouped.join(children, NODE, "left").withColumn(
        "n_children",
        F.when(F.col("single"), F.when(F.col("last"), 0).otherwise(1))
        .otherwise(F.coalesce("children", F.lit(0)))
        .cast("bigint"),
    )
    counted = cut_lineage(counted.drop("children"))

    # Weights go to the smallest member, at the node's depth.
    leaf = (F.col("single") | (F.col("n_children") == 0)).cast("bigint")
    weights = counted.select(
        F.col("conv_id").alias("conv"),
        "depth",
        leaf.alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    weighted = shared.join(weights, ["conv", "depth"], "left").select(
        "conv", CHUNK, "depth", *NODE,
        *(F.coalesce(w, F.lit(0)).alias(w) for w in ("leaf", "saved")),
    )
    along = Chunks(cut_lineage(weighted), ("conv",), open_rows.groups)
    totals = along.totals("leaf", "saved").drop("leaf_inside", "saved_inside")
    earlier = along.within("depth").rowsBetween(Window.unboundedPreceding, -1)
    deeper = along.join(totals).select(
        *NODE,
        *(
            (
                F.col(f"{w}_total") - F.col(f"{w}_before")
                - F.coalesce(F.sum(w).over(earlier), F.lit(0))
            ).alias(w)
            for w in ("leaf", "saved")
        ),
    )
    subtree = deeper.groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    ended = ends(shared.where("last"), how)
    exact = (
        _with_parents(counted)
        .join(subtree, NODE)
        .join(ended, NODE, "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))
        .select(*tails.columns)
    )
    return tails.unionByName(more_tails).unionByName(exact)
