"""Quality classifier: scores of whole texts by supervised subword embeddings.

The classifier (`embedder.py`) is trained on a bounded sample of the labelled rows, chosen
by hash of their ids. The texts of the sample become counts per bucket where they are; the driver
receives those counts and trains. Scoring is one pass over the texts, without a shuffle, with one
number per bucket in every task. Scores depend on the text alone.

Cases: null and empty texts have a line end and nothing else, and a score like any text.
Very long texts are read whole, in pieces. A document with several labels counts as the class
that most of them name (ties: class 1); labels without id or class, and labels of no document,
teach nothing. Without any label all scores are 0.5; with labels of one class only, all are that
class's smoothed share. Repeated rows get equal scores. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.embedder import Embedder, Weights, counted, learned, scores
from holdfast.llm.sampling import picked
from holdfast.llm.text import slices
from holdfast.session import cut_lineage


def _counts(how: Embedder):
    def count(batches):
        for part in slices(batches, "text"):
            found = counted(part.column("text"), how)
            buckets, numbers = (
                pa.array([x.tobytes() for x in side], pa.binary()) for side in zip(*found)
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("good"), buckets, numbers], ["good", "buckets", "numbers"]
            )

    return count


def trained(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    how: Embedder = Embedder(),
) -> Weights:
    """Weights from about `how.sample` labelled rows of which `usable` (over `id`) holds."""
    known = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("good"))
    )
    if usable is not None:
        known = known.where(usable)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # About `how.sample` ids are broadcast. An id that many documents share is bounded as well.
    some = F.broadcast(picked(known, how.sample, "id", seed=how.seed))
    sample = cut_lineage(texts.join(some, "id").dropDuplicates(["id", "text"]))
    found = (
        picked(sample, how.sample, "id", "text", seed=how.seed)
        .select("good", "text")
        .mapInArrow(_counts(how), "good int, buckets binary, numbers binary")
        .toArrow()
    )
    rows = [
        (np.frombuffer(b.as_py(), np.int32), np.frombuffer(n.as_py(), np.int32), g.as_py())
        for g, b, n in zip(*(found.column(c) for c in ("good", "buckets", "numbers")))
    ]
    # In an order of their own, so that the weights do not depend on partitions.
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))
    return learned(rows, how)


def scored(
    docs: DataFrame,
    weights: Weights,
    id_column: str = "doc_id",
    text_column: str = "text",
    how: Embedder = Embedder(),
) -> DataFrame:
    """(id, score) for every row: the probability of label 1."""

    def score(batches):
        for part in slices(batches, "text"):
            likely = scores(part.column("text"), weights, how)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(likely)], ["id", "score"]
            )

    rows = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")
    )
    return rows.mapInArrow(score, "id bigint, score double").withColumnRenamed("id", id_column)
