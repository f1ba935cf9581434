"""A Bloom filter of 64-bit hashes, built by Spark in parts and small enough to send to all tasks.

Cases: an empty table gives a filter that holds nothing; null hashes are left out; repeated hashes
count once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.text import mix

# Hashes in one part, which one task turns into bits, and bits wanted for each of them.
PART = 1 << 20
BITS = 16


@dataclass(frozen=True)
class Bloom:
    """`rows` holds the bits of each part, `size` is their number, `probes` those of a hash."""

    rows: np.ndarray
    size: int
    probes: int

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """False for a hash that was not put in, with few exceptions; true for all that were."""
        mixed = mix(hashes)
        part = (hashes >> np.uint64(40)) % np.uint64(len(self.rows))
        left = np.arange(len(hashes))
        # Each probe looks only at what the probes before it let through.
        for i in range(self.probes):
            at = _place(mixed[left], i, self.size)
            byte = self.rows[part[left], at >> np.uint64(3)]
            left = left[(byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        found = np.zeros(len(hashes), bool)
        found[left] = True
        return found


def _place(mixed: np.ndarray, probe: int, size: int) -> np.ndarray:
    """The bit of each hash that this probe looks at."""
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    return ((mixed & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * step) % np.uint64(size)


def bloom_filter(hashes: DataFrame, column: str, n: int, most: int) -> Bloom:
    """The filter of about `n` values of `column` (bigint), in at most about `most` bytes.

    Within `most` bytes a hash has 16 bits, and one foreign hash in some 2000 passes. Beyond
    that the bits of a hash become fewer and more foreign ones pass; none of its own is lost.
    """
    parts = -(-max(n, 1) // PART)
    wanted = min(BITS * -(-max(n, 1) // parts), 8 * most // parts)
    size = max(8, (wanted + 7) // 8 * 8)
    probes = int(min(8, max(1, round(0.69 * size * parts / max(n, 1)))))

    def filled(key: tuple, table: pa.Table) -> pa.Table:
        values = table.column("hash").combine_chunks().to_numpy().view(np.uint64)
        bits = np.zeros(size, np.uint8)
        mixed = mix(values)
        for i in range(probes):
            bits[_place(mixed, i, size)] = 1
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": [packed]})

    built = (
        hashes.select(F.col(column).alias("hash"))
        .where("hash is not null")
        .withColumn("part", F.shiftrightunsigned("hash", 40) % parts)
        .groupBy("part")
        .applyInArrow(filled, "part bigint, bits binary")
    )
    rows = np.zeros((parts, size // 8), np.uint8)
    # At most `most` bytes in all.
    for row in built.toLocalIterator():
        rows[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return Bloom(rows, size, probes)
