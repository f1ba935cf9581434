"""Work that needs a total order: running totals and exact quantiles of any number of rows.

Rows are first reduced to one per distinct value, then range-partitioned and written. Each
range ("chunk") is a bounded slice, whatever the value frequencies were. Totals of the
earlier chunks turn positions inside a chunk into positions in the whole, so no task ever
holds a whole column or a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numbers import nan_to_null
from holdfast.session import cut_lineage

CHUNK = "chunk"
VALUE = "value"
ROWS = "n"

# Up to this many groups, what is known per group and chunk is small enough to broadcast.
FEW_GROUPS = 10_000


@dataclass(frozen=True)
class Chunks:
    """Rows in ranges of a total order, within groups, and about how many groups there are."""

    rows: DataFrame
    by: tuple[str, ...]
    groups: int

    def totals(self, *weights: str) -> DataFrame:
        """Per group and chunk: sums inside the chunk, in earlier chunks and in the group."""
        parts = self.rows.groupBy(*self.by, CHUNK).agg(
            *(F.sum(w).alias(f"{w}_inside") for w in weights)
        )
        group = Window.partitionBy(*self.by)
        earlier = group.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        sums = {}
        for w in weights:
            inside = F.sum(f"{w}_inside")
            sums[f"{w}_before"] = F.coalesce(inside.over(earlier), F.lit(0))
            sums[f"{w}_total"] = inside.over(group)
        return parts.withColumns(sums)

    def join(self, facts: DataFrame) -> DataFrame:
        """Rows with what is known about their group and chunk.

        `facts` has at most one row per group and chunk. It is broadcast where groups are
        few; otherwise both sides are shuffled on (group, chunk), which splits a large
        group over many tasks.
        """
        few = self.groups <= FEW_GROUPS
        side = F.broadcast(facts) if few else facts.hint("merge")
        return self.rows.join(side, [*self.by, CHUNK])

    def sizes(self) -> DataFrame:
        return self.totals(ROWS).withColumnsRenamed(
            {f"{ROWS}_inside": "inside", f"{ROWS}_before": "before", f"{ROWS}_total": "total"}
        )

    def within(self, order: str):
        """Window over the rows of one chunk of one group."""
        return Window.partitionBy(*self.by, CHUNK).orderBy(order)


def in_chunks(
    df: DataFrame, order: str, by: Sequence[str] = (), groups: int | None = None
) -> Chunks:
    """`df` range-partitioned on group and `order`, each row tagged with its range's number.

    The ranges come from sampling, so they are fixed in a written table before anything
    reads them twice. Unless the number of groups is given, it is estimated from that table.
    """
    ranged = df.repartitionByRange(*by, order).withColumn(CHUNK, F.spark_partition_id())
    rows = cut_lineage(ranged)
    if not by:
        groups = 1
    elif groups is None:
        groups = rows.agg(F.approx_count_distinct(F.struct(*by))).first()[0]
    return Chunks(rows, tuple(by), groups)


def running_totals(chunks: Chunks, order: str, weights: Sequence[str]) -> DataFrame:
    """Adds ``<weight>_before``: the sum over all earlier rows of the same group."""
    offsets = chunks.totals(*weights).select(
        *chunks.by, CHUNK, *(F.col(f"{w}_before").alias(f"_{w}") for w in weights)
    )
    earlier = chunks.within(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {
        f"{w}_before": F.col(f"_{w}") + F.coalesce(F.sum(w).over(earlier), F.lit(0))
        for w in weights
    }
    return chunks.join(offsets).withColumns(sums).drop(*(f"_{w}" for w in weights))


def value_chunks(
    df: DataFrame, column: str, by: Sequence[str] = (), groups: int | None = None
) -> Chunks:
    """Distinct values of `column` per group with their frequency, chunked in value order."""
    counts = (
        df.select(*by, nan_to_null(F.col(column).cast("double")).alias(VALUE))
        .where(F.col(VALUE).isNotNull())
        .groupBy(*by, VALUE)
        .agg(F.count(F.lit(1)).alias(ROWS))
    )
    return in_chunks(counts, VALUE, by, groups)


def _between(low: Column, high: Column, weight: Column) -> Column:
    """Linear interpolation, reckoned from the nearer end so that both ends are met exactly."""
    gap = high - low
    return F.when(weight < 0.5, low + gap * weight).otherwise(high - gap * (1 - weight))


def _place(p: float, interpolate: bool) -> str:
    """SQL for the ranks that decide quantile `p` of `total` rows, counted from 1."""
    at = f"((total - 1) * {p}D)" if interpolate else f"(greatest(ceil(total * {p}D), 1) - 1)"
    return ", ".join(
        f"named_struct('p', {p}D, 'side', '{side}', 'rank', cast({edge}({at}) + 1 as bigint),"
        f" 'weight', cast({at} - floor({at}) as double))"
        for side, edge in (("low", "floor"), ("high", "ceil"))
    )


def chunk_quantiles(
    chunks: Chunks, probs: Sequence[float], interpolate: bool = True
) -> DataFrame:
    """(by..., p, value): exact quantiles of value chunks.

    Interpolated ones lie between the two elements next to position (n - 1)p, as pandas
    has it; the others are the smallest element with at least a share p at or below it.
    Only the chunks that hold a wanted rank are sorted.
    """
    places = ", ".join(_place(float(p), interpolate) for p in probs)
    here = f"filter(array({places}), w -> w.rank > before and w.rank <= before + inside)"
    wanted = (
        chunks.sizes()
        .select(*chunks.by, CHUNK, "before", F.expr(here).alias("wanted"))
        .where("size(wanted) > 0")
    )
    upto = chunks.within(VALUE).rowsBetween(Window.unboundedPreceding, 0)
    found = f"filter(wanted, w -> w.rank > upto - {ROWS} and w.rank <= upto)"
    hits = (
        chunks.join(wanted)
        .withColumn("upto", F.col("before") + F.sum(ROWS).over(upto))
        .select(*chunks.by, VALUE, F.expr(f"explode({found})").alias("hit"))
    )
    ends = hits.groupBy(*chunks.by, F.col("hit.p").alias("p")).agg(
        F.expr(f"max(if(hit.side = 'low', {VALUE}, null))").alias("low"),
        F.expr(f"max(if(hit.side = 'high', {VALUE}, null))").alias("high"),
        F.max("hit.weight").alias("weight"),
    )
    between = _between(F.col("low"), F.col("high"), F.col("weight"))
    return ends.select(*chunks.by, "p", between.alias(VALUE))


def exact_quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    interpolate: bool = True,
) -> DataFrame:
    """(by..., p, value) for a numeric column; null and NaN are left out."""
    return chunk_quantiles(value_chunks(df, column, by), probs, interpolate)


def quantiles_wide(chunks: Chunks, names: dict[float, str]) -> DataFrame:
    """One row per group with a column per interpolated quantile."""
    return (
        chunk_quantiles(chunks, list(names))
        .groupBy(*chunks.by)
        .agg(*(F.expr(f"max(if(p = {p}D, {VALUE}, null))").alias(n) for p, n in names.items()))
    )
