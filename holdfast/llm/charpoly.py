"""Eigenvalues and eigenvectors of an exact integer matrix, by its characteristic polynomial.

The matrix is symmetric and has no negative eigenvalue, as a scatter matrix. Modulo each of
some primes it is brought to Hessenberg form by similarity, from which the polynomial follows by
a recurrence. The coefficients are put together by Chinese remaindering. All roots are real, so the
number of sign changes of the polynomial's coefficients about a point is the number of roots
above it (Descartes; Budan), multiplicities included: bisection by that count isolates every root
to any precision, without rounding. Eigenvectors come from inverse iteration in decimal
arithmetic of the same precision.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal, getcontext, localcontext
from math import comb

import numpy as np

Matrix = Sequence[Sequence[int]]

# Primes lie below this, so that a product and one sum of them fit 64 bits.
_TOP = 1 << 31


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide every number below 3.2e9."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def bound(matrix: Matrix) -> int:
    """No coefficient is larger: the k-th is at most comb(d, k) (trace / d) ** k, as the mean
    of the products of k eigenvalues is at most the k-th power of their mean."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    return max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))


def primes_for(matrix: Matrix) -> list[int]:
    """Enough primes to tell the coefficients, signs included."""
    need, found, product, n = 2 * bound(matrix) + 1, [], 1, _TOP - 1
    while product <= need:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def residues(matrix: Matrix, primes: Sequence[int]) -> np.ndarray:
    """(primes, d + 1): the monic characteristic polynomial modulo each prime, x**0 first.

    All primes are worked on together; every entry stays below 2**31.
    """
    d, n = len(matrix), len(primes)
    p = np.array(primes, np.int64)
    entries = [[[v % int(q) for v in row] for row in matrix] for q in primes]
    h = np.array(entries, np.int64).reshape(n, d, d)
    each, mod = np.arange(n), p[:, None]
    for k in range(1, d - 1):
        # A pivot other than 0 below the diagonal of column k - 1; where there is none,
        # the column is done, and multipliers of 0 change nothing.
        below = h[:, k:, k - 1] != 0
        at = k + below.argmax(axis=1)
        rows = h[each, at].copy()
        h[each, at], h[:, k] = h[:, k].copy(), rows
        columns = h[each, :, at].copy()
        h[each, :, at], h[:, :, k] = h[:, :, k].copy(), columns
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(h[:, k, k - 1], p)])
        times = h[:, k + 1 :, k - 1] * inverse[:, None] % mod
        h[:, k + 1 :] -= times[:, :, None] * h[:, None, k] % mod[:, None]
        h[:, k + 1 :] %= mod[:, None]
        # The inverse operation on columns keeps the matrix similar.
        moved = np.zeros((n, d), np.int64)
        for j in range(d - k - 1):
            moved += h[:, :, k + 1 + j] * times[:, j, None] % mod
        h[:, :, k] = (h[:, :, k] + moved) % mod
    # Polynomials of the leading blocks: p_k = (x - h_kk) p_(k-1) - sum of products below.
    known = np.zeros((d + 1, n, d + 1), np.int64)
    known[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((n, d + 1), np.int64)
        new[:, 1:] = known[k - 1, :, :-1]
        new = (new - h[:, k - 1, k - 1, None] * known[k - 1] % mod) % mod
        chain = np.ones(n, np.int64)
        for i in range(k - 1, 0, -1):
            chain = chain * h[:, i, i - 1] % p
            factor = chain * h[:, i - 1, k - 1] % p
            new = (new - factor[:, None] * known[i - 1] % mod) % mod
        known[k] = new
    return known[d]


def remaindered(found: Sequence[Sequence[int]], primes: Sequence[int]) -> list[int]:
    """Integers from their residues (one row per prime), nearest to 0."""
    values, product = [0] * len(found[0]), 1
    for row, q in zip(found, primes):
        inverse = pow(product, -1, q)
        values = [v + product * ((int(r) - v) * inverse % q) for v, r in zip(values, row)]
        product *= q
    return [v - product if v > product // 2 else v for v in values]


def _shifted(polynomial: Sequence[int], at: int) -> list[int]:
    """Coefficients about the integer `at`, by repeated synthetic division."""
    out = list(polynomial)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += at * out[j + 1]
    return out


def _above(polynomial: Sequence[int], at: int) -> int:
    """How many roots, counted with multiplicity, are larger than `at`. All must be real."""
    signs = [c > 0 for c in _shifted(polynomial, at) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(polynomial: Sequence[int], many: int, bits: int) -> list[tuple[int, int]]:
    """(root, multiplicity), largest first, of the first `many` positive roots.

    `root / 2**bits` is at most 2**-bits above the true root. Roots closer than that count as
    one with their multiplicities added.
    """
    d = len(polynomial) - 1
    # The polynomial of the roots times 2**bits, so that all points are integers.
    scaled = [c << (bits * (d - k)) for k, c in enumerate(polynomial)]
    trace = -scaled[d - 1]
    out: list[tuple[int, int]] = []
    seen = 0
    high = trace + 1
    positive = _above(scaled, 0)
    while seen < min(many, positive):
        # The smallest integer with no more than `seen` roots above it.
        low, top = 0, high
        while top - low > 1:
            middle = (low + top) // 2
            if _above(scaled, middle) > seen:
                low = middle
            else:
                top = middle
        found = _above(scaled, top - 1) - seen
        out.append((top, found))
        seen += found
        high = top
    return out


def _solve(rows: list[list[Decimal]], sides: list[list[Decimal]]) -> list[list[Decimal]]:
    """Solutions of a square system for some right sides, with row pivots."""
    d = len(rows)
    m = np.array([[*row, *(s[i] for s in sides)] for i, row in enumerate(rows)], dtype=object)
    # In place of a pivot that vanishes: the matrix is singular where the root is exact.
    largest = max(Decimal(1), *(abs(v) for row in rows for v in row))
    least = largest * Decimal(10) ** (10 - getcontext().prec)
    for k in range(d):
        at = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        m[[k, at]] = m[[at, k]]
        if abs(m[k, k]) < least:
            m[k, k] = least
        for i in range(k + 1, d):
            if m[i, k]:
                m[i, k:] -= m[k, k:] * (m[i, k] / m[k, k])
    for k in range(d - 1, -1, -1):
        m[k, d:] /= m[k, k]
        if k:
            m[:k, d:] -= np.outer(m[:k, k], m[k, d:])
    return [list(m[:, d + j]) for j in range(len(sides))]


def null_vectors(matrix: Matrix, root: Decimal, many: int) -> list[list[float]]:
    """`many` orthonormal vectors that `matrix - root` takes to 0, by inverse iteration.

    Runs in the caller's decimal precision; starts are unit vectors of a fixed draw.
    """
    d = len(matrix)
    rows = [
        [Decimal(v) - (root if i == j else 0) for j, v in enumerate(row)]
        for i, row in enumerate(matrix)
    ]
    draw = np.random.default_rng(d).integers(-999, 1000, (many, d))
    vectors = [[Decimal(int(v)) for v in row] for row in draw]
    for _ in range(3):
        vectors = _orthonormal(_solve(rows, vectors))
    return [[float(v) for v in vector] for vector in vectors]


def _orthonormal(vectors: list[list[Decimal]]) -> list[list[Decimal]]:
    out: list[list[Decimal]] = []
    for vector in vectors:
        largest = max(abs(v) for v in vector)
        vector = [v / largest for v in vector]
        for _ in range(2):
            for other in out:
                part = sum(a * b for a, b in zip(vector, other))
                vector = [a - part * b for a, b in zip(vector, other)]
        size = sum(v * v for v in vector).sqrt()
        out.append([v / size for v in vector])
    return out


def principal(
    matrix: Matrix, polynomial: Sequence[int], many: int, bits: int = 120
) -> list[tuple[Decimal, list[float]]]:
    """The first `many` positive eigenvalues, largest first, with unit eigenvectors.

    Each eigenvalue is right to `bits` - 10 or more binary digits of its own.
    """
    size = sum(matrix[i][i] for i in range(len(matrix))).bit_length()
    spare = max(0, bits - size)
    roots = largest_roots(polynomial, many, spare)
    while roots and roots[-1][0].bit_length() < bits - 10:
        spare += bits - roots[-1][0].bit_length()
        roots = largest_roots(polynomial, many, spare)
    out: list[tuple[Decimal, list[float]]] = []
    with localcontext() as context:
        # Twice the digits of the roots, counted from the largest.
        context.prec = 2 * (size + spare) * 3 // 10 + 10
        for root, copies in roots:
            value = Decimal(root) / (1 << spare)
            out += [(value, vector) for vector in null_vectors(matrix, value, copies)]
    return out[:many]
