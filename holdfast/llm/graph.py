"""Connected components of large sparse graphs, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.session import cut_lineage

NODE, PART = "node", "part"


def _roots(step: DataFrame) -> DataFrame:
    """Follow (`node`, `part`) pointers, which only ever lead to smaller numbers, to their ends."""
    step = cut_lineage(step)
    while True:
        above = step.select(F.col(NODE).alias(PART), F.col(PART).alias("up"))
        jump = step.join(above, PART, "left").select(
            NODE, F.coalesce("up", PART).alias(PART), F.col("up").isNotNull().alias("moved")
        )
        step = cut_lineage(jump)
        if not step.where("moved").take(1):
            return step.select(NODE, PART)


def merge(parts: DataFrame, links: DataFrame) -> DataFrame:
    """`parts` (node, part) after joining the parts that `links` (a, b) connect.

    A part is numbered by its smallest node. Each turn points every part at its smallest
    neighbour and follows the pointers, so the number of parts at least halves wherever
    links remain; a star is done in one turn.
    """
    while True:
        ends = links.join(parts.select(F.col(NODE).alias("a"), F.col(PART).alias("pa")), "a")
        ends = ends.join(parts.select(F.col(NODE).alias("b"), F.col(PART).alias("pb")), "b")
        cross = cut_lineage(
            ends.where("pa != pb")
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
            .distinct()
        )
        if not cross.take(1):
            return parts
        lower = cross.groupBy(F.col("a").alias(NODE)).agg(F.min("b").alias(PART))
        roots = _roots(lower).select(F.col(NODE).alias(PART), F.col(PART).alias("root"))
        parts = cut_lineage(
            parts.join(roots, PART, "left").select(NODE, F.coalesce("root", PART).alias(PART))
        )
        # A part is named by a node in it, so links between parts are links between nodes.
        links = cross
