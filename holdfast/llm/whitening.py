"""Embedding whitening: vectors on the principal components of their covariance, scaled to one.

Entries become integers, so that n times the sum of products of the centred vectors is an exact
integer matrix: products are taken about whole numbers next to the means, in blocks that
double precision holds without rounding, and the rest is corrected in integers. The
characteristic polynomial of that matrix is found modulo primes, each in a task of its own
(`charpoly.py`); roots and components follow from it on the driver, whose work depends on the
dimension alone. The table is read four times and never shuffled or written: sums, products,
moments of the result, result.

Cases: vectors that are null, empty, or hold null or non-finite entries, or ones of 2**52 and
more in size (whose integers would not fit), are dropped; so are vectors that are not as long
as most vectors are (ties: the longer). Components are those with a positive eigenvalue: none for
equal vectors or a single one, so nothing is returned for them. Eigenvalues that agree to 30
digits have an orthonormal basis of their common space. Repeated rows count and return as often
as they occur; null ids stay null. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm import charpoly


@dataclass(frozen=True)
class Whitening:
    """Entry c becomes floor(scale * c) + shift. `together` primes are one task's work."""

    components: int = 8
    scale: int = 1024
    shift: int = 100_000
    together: int = 16


# Products of two digits of 20 bits, 8192 of them added, are exact in double precision.
_DIGIT, _BLOCK = 20, 8192

# Sums travel as two decimals: v = high * 2**90 + low.
_SPLIT = 90
_PARTS = "high decimal(38,0), low decimal(38,0)"


def _vectors(column: pa.ListArray, how: Whitening) -> np.ndarray:
    """Integers of vectors of one length, one row each."""
    flat = np.asarray(column.flatten(), np.float64)
    whole = np.floor(flat * how.scale).astype(np.int64) + how.shift
    return whole.reshape(len(column), -1)


def _batches(batches, how: Whitening) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(at, _BLOCK)
            yield part, _vectors(part.column("vector"), how)


def _exact(values: list[int]) -> list[pa.Array]:
    kind = pa.decimal128(38, 0)
    high = [Decimal(v >> _SPLIT) for v in values]
    low = [Decimal(v & ((1 << _SPLIT) - 1)) for v in values]
    return [pa.array(high, kind), pa.array(low, kind)]


def _total(high: Decimal, low: Decimal) -> int:
    return (int(high) << _SPLIT) + int(low)


def usable(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of the rows that are fitted and returned."""
    rows = df.select(
        F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    # NaN is larger than any number here, and null is not smaller.
    fits = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float(1 << 52), F.lit(False)))
    known = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & fits)
    sizes = known.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.agg(F.max(F.struct("n", "size")).alias("most")).select("most.size").scalar()
    return known.where(F.size("vector") == usual)


def sums(rows: DataFrame, how: Whitening) -> tuple[int, list[int]]:
    """The number of vectors, and the exact sum per dimension."""

    def add(batches):
        total, n = None, 0
        for _, x in _batches(batches, how):
            # 8192 numbers below 2**62 in two halves.
            part = (x >> 31).sum(axis=0).astype(object) * (1 << 31)
            part += (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
            total, n = part if total is None else total + part, n + len(x)
        if n:
            place = pa.array(np.arange(len(total)), pa.int32())
            number = pa.array(np.full(len(total), n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [place, number, *_exact([int(v) for v in total])], ["place", "n", "high", "low"]
            )

    found = (
        rows.select("vector")
        .mapInArrow(add, f"place int, n bigint, {_PARTS}")
        .groupBy("place")
        .agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
        .orderBy("place")
        .collect()
    )
    return (found[0]["n"] if found else 0), [_total(r["high"], r["low"]) for r in found]


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of a block, as Python integers."""
    largest = int(np.abs(y).max(initial=0))
    count = max(1, -(-largest.bit_length() // _DIGIT))
    digits = [((y >> (_DIGIT * k)) & ((1 << _DIGIT) - 1)) for k in range(count - 1)]
    digits.append(y >> (_DIGIT * (count - 1)))
    digits = [part.astype(np.float64) for part in digits]
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            total += (a.T @ b).astype(np.int64).astype(object) * (1 << (_DIGIT * (i + j)))
    return total


def scatter(rows: DataFrame, n: int, total: list[int], how: Whitening) -> list[list[int]]:
    """n squared times the covariance, exactly: n sum((x - m)(x - m)') for the mean m."""
    centre = [s // n for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]
    d = len(total)
    upper = np.triu_indices(d)

    def add(batches):
        found = None
        middle = np.array(centre, np.int64)
        for _, x in _batches(batches, how):
            part = _products(x - middle)
            found = part if found is None else found + part
        if found is not None:
            values = [int(v) for v in found[upper]]
            places = [pa.array(side, pa.int32()) for side in upper]
            yield pa.RecordBatch.from_arrays(
                [*places, *_exact(values)], ["i", "j", "high", "low"]
            )

    found = (
        rows.select("vector")
        .mapInArrow(add, f"i int, j int, {_PARTS}")
        .groupBy("i", "j")
        .agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
        .collect()
    )
    matrix = [[0] * d for _ in range(d)]
    for r in found:
        i, j = r["i"], r["j"]
        value = n * _total(r["high"], r["low"]) - rest[i] * rest[j]
        matrix[i][j] = matrix[j][i] = value
    return matrix


def characteristic(rows: DataFrame, matrix: list[list[int]], how: Whitening) -> list[int]:
    """The characteristic polynomial, x**0 first: residues in tasks, put together here."""
    primes = charpoly.primes_for(matrix)

    def reduce(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, how.together):
                own = batch.column("prime").to_pylist()[at : at + how.together]
                left = pa.array(charpoly.residues(matrix, own).tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(own), left], ["prime", "left"])

    spark = rows.sparkSession
    dealt = spark.createDataFrame([(p,) for p in primes], "prime bigint")
    tasks = -(-len(primes) // how.together)
    found = (
        dealt.repartition(tasks)
        .mapInArrow(reduce, "prime bigint, left array<bigint>")
        .collect()
    )
    return charpoly.remaindered([r["left"] for r in found], [r["prime"] for r in found])


@dataclass(frozen=True)
class Basis:
    """What whitens a vector x: ``(x - total / n) @ axes``, and each axis's share of variance."""

    n: int
    total: list[int]
    axes: np.ndarray
    explained: list[float]

    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole number and the rest."""
        whole = [s // self.n for s in self.total]
        rest = [float(Decimal(s - self.n * c) / self.n) for s, c in zip(self.total, whole)]
        return np.array(whole, np.int64), np.array(rest)


def fitted(rows: DataFrame, how: Whitening) -> Basis | None:
    """The basis of (id, vector) rows; None where there is no variance."""
    n, total = sums(rows, how)
    if not n:
        return None
    matrix = scatter(rows, n, total, how)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return None
    found = charpoly.principal(matrix, characteristic(rows, matrix, how), how.components)
    axes, explained = [], []
    with localcontext() as context:
        context.prec = 50
        for value, vector in found:
            # The matrix is n * n times the covariance.
            deviation = float(value.sqrt() / n)
            axes.append(np.array(vector) / deviation)
            explained.append(float(value / trace))
    return Basis(n, total, np.array(axes).T, explained)


def _projected(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates of vectors; added up in one order, so that no vector's depend on its batch."""
    y = (x - whole).astype(np.float64) - rest
    total = np.zeros((len(x), axes.shape[1]))
    for j, axis in enumerate(axes):
        total += y[:, j, None] * axis
    return total


def identity_error(rows: DataFrame, basis: Basis, how: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity."""
    k = basis.axes.shape[1]
    whole, rest = basis.offsets()
    axes = basis.axes

    def add(batches):
        mean, square = np.zeros(k), np.zeros((k, k))
        for _, x in _batches(batches, how):
            w = _projected(x, whole, rest, axes)
            mean += w.sum(axis=0)
            square += w.T @ w
        i, j = (side.ravel() for side in np.indices((k, k)))
        places = [pa.array(np.append(i, np.arange(k)), pa.int32())]
        places.append(pa.array(np.append(j, np.full(k, -1)), pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*places, pa.array(np.append(square.ravel(), mean))], ["i", "j", "total"]
        )

    found = (
        rows.select("vector")
        .mapInArrow(add, "i int, j int, total double")
        .groupBy("i", "j")
        .agg((F.sum("total") / basis.n).alias("value"))
        .collect()
    )
    at = {(r["i"], r["j"]): r["value"] for r in found}
    return max(
        abs(at[i, j] - at[i, -1] * at[j, -1] - (i == j)) for i in range(k) for j in range(k)
    )


def _deviations(x: np.ndarray, basis: Basis) -> list[int | None]:
    """Per vector the sum of (n x - total) ** 2; null beyond 38 digits."""
    whole = np.array([s // basis.n for s in basis.total], np.int64)
    rest = [s - basis.n * (s // basis.n) for s in basis.total]
    y = x - whole
    largest = basis.n * (int(np.abs(y).max(initial=0)) + 1)
    if largest * largest * len(rest) < 1 << 63:
        away = basis.n * y - np.array(rest, np.int64)
        return [Decimal(v) for v in (away * away).sum(axis=1).tolist()]
    away = y.astype(object) * basis.n - np.array(rest, object)
    exact = [int(v) for v in (away * away).sum(axis=1)]
    return [Decimal(v) if v < 10**38 else None for v in exact]


def whitened(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    how: Whitening = Whitening(),
) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) per vector; `whitened` and
    `explained` have one entry per component."""
    rows = usable(df, id_column, vector_column)
    kind = rows.schema["id"].dataType
    basis = fitted(rows, how)
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ]
    )
    if basis is None:
        found = df.sparkSession.createDataFrame([], schema)
        shares, n, error = [], 0, 0.0
    else:
        whole, rest = basis.offsets()

        def project(batches):
            for part, x in _batches(batches, how):
                w = _projected(x, whole, rest, basis.axes)
                starts = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
                lists = pa.ListArray.from_arrays(starts, pa.array(w.ravel()))
                deviations = pa.array(_deviations(x, basis), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), deviations, lists], ["id", "deviation", "whitened"]
                )

        found = rows.mapInArrow(project, schema)
        shares, n = basis.explained, basis.n
        error = identity_error(rows, basis, how)
    return found.select(
        F.col("id").alias(id_column),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, shares)).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
