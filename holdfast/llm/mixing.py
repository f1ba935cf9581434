"""Mixing sources to target weights by repeating documents.

The words of each source are summed, targets are shared out by weight, and a document is
emitted floor(rate) times plus once more if a draw from the hash of its id, source and text falls
below the fraction of the rate. Rate is target over size of the source. Targets stop at `most` times
the source's size; what is above goes to the other sources by weight until none is above.

Cases: null texts have no words; null is a source of its own, last in order; sources without
words have target 0 and emit nothing. Rows that are equal in id, source and text share one draw; a
null id draws as empty text. Very long texts are counted whole. An empty table gives an empty
result. In `mixture`, columns of the table that
are named like an added one keep their values and the added one gets a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.hashing import uniform_sql
from holdfast.llm.text import WORD
from holdfast.operators.ordered import in_chunks, running_totals
from holdfast.session import cut_lineage


@dataclass(frozen=True)
class Mixing:
    """`weights` go to the sources in order of name, over and over; `most` bounds the rate."""

    weights: Sequence[float] = (5, 2, 1)
    most: float = 3
    salt: str = "mixing"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, how: Mixing = Mixing()) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.struct(F.col("source").isNull().alias("last"), "source")
    named = sums.select("source", "source_size", order.alias("key"), F.lit(1).alias("one"))
    ranked = running_totals(in_chunks(named, "key"), "key", ["one"])
    weights = F.array(*(F.lit(float(w)) for w in how.weights))
    place = (F.col("one_before") % len(how.weights) + 1).cast("int")
    known = cut_lineage(
        ranked.select(
            "source",
            "source_size",
            F.element_at(weights, place).alias("weight"),
            (F.col("source_size") * float(how.most)).alias("top"),
        )
    )
    total = known.agg(F.sum("source_size")).first()[0] or 0
    # One number per turn: target words per unit of weight for the sources below their top.
    level, above = None, F.lit(False)
    while True:
        full, open_weight = known.agg(
            F.sum(F.when(above, F.col("top"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if not open_weight:
            break
        now = (total - (full or 0.0)) / open_weight
        if now == level:
            break
        level = now
        above = F.col("top") < F.lit(level) * F.col("weight")
    wanted = F.when(above, F.col("top")).otherwise(F.lit(level or 0.0) * F.col("weight"))
    return known.select(
        "source", "source_size", wanted.alias("target"),
        F.coalesce(F.try_divide(wanted, F.col("source_size")), F.lit(0.0)).alias("rate"),
    )


def draw_key(id_column: str, source_column: str, text_column: str) -> Column:
    """What a row's draw depends on. Ids may be missing or shared, so source and text count."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_column, source_column)]
    text = F.md5(F.coalesce(F.col(text_column), F.lit("")))
    return F.concat_ws(":", *parts, text)


def copies(key: str, rate: str, how: Mixing = Mixing()) -> Column:
    """How often a row is emitted."""
    draw = F.expr(uniform_sql(f"`{key}`", how.salt))
    whole = F.floor(rate)
    return (whole + F.when(draw < F.col(rate) - whole, 1).otherwise(0)).cast("bigint")


def mixed_sizes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    how: Mixing = Mixing(),
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row of `docs`."""
    sized = cut_lineage(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            word_count(F.col(text_column)).alias("size"),
            draw_key(id_column, source_column, text_column).alias("key"),
        )
    )
    plan = targets(sized, how).withColumnRenamed("source", "name")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("name")))
    return joined.select(
        F.col("id").alias(id_column),
        "size",
        "source_size",
        "target",
        copies("key", "rate", how).alias("copies"),
    ).withColumn("taken", F.col("size") * F.col("copies"))


def mixture(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    how: Mixing = Mixing(),
) -> DataFrame:
    """The rows of the mix: those of `docs`, repeated, with `copy` counting from 0."""
    sized = docs.select(
        F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size")
    )
    plan = targets(sized, how).select(F.col("source").alias("name"), "rate")
    # The caller's columns stay in one struct, so that no helper's name can meet theirs.
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(source_column).alias("source"),
        draw_key(id_column, source_column, text_column).alias("key"),
    )
    times = packed.join(plan, F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "times", copies("key", "rate", how)
    )
    copy = "copy"
    while copy in docs.columns:
        copy += "_"
    return (
        times.where("times > 0")
        .withColumn("nth", F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("int"))))
        .select("row.*", F.col("nth").alias(copy))
    )
