"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST).

Inertia counts of shifted matrices place the eigenvalues in intervals. For each interval a circle is drawn around it; complex
solves of the shifted matrix at quadrature points of the circle, each a row of a Spark job, sum to a projection onto the
interval's eigenvectors. Rayleigh-Ritz extracts them, and the inertia counts tell whether one is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Quadrature points on a half circle, eigenvalues of one interval, rounds of projection at most.
POINTS = 8
PER_INTERVAL = 2
ROUNDS = 60
#: Residual of a converged pair, as a share of the matrix's size.
EXACT = 1e-13


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared side diagonal of a similar tridiagonal matrix, by Householder reflections."""
    a = matrix.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size:
            v = x / size
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = p - v * (v @ p)
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            # The reflected column has one entry, of the column's own length.
            a[k + 1, k] = a[k, k + 1] = np.linalg.norm(a[k + 1:, k])
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def count_above(diagonal: np.ndarray, sides: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Eigenvalues above each shift: by Sylvester's law, the positive pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot = np.full(len(shifts), np.inf)
    found = np.zeros(len(shifts), int)
    for entry, side in zip(diagonal, np.r_[0.0, sides], strict=True):
        pivot = entry - shifts - side / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        found += pivot > 0
    return found


def bisect(diagonal: np.ndarray, sides: np.ndarray, wanted: int, low: float, high: float) -> np.ndarray:
    """The ``wanted`` largest eigenvalues, falling, each to rounding, by inertia counts alone."""
    below, above = np.full(wanted, low), np.full(wanted, high)
    places = np.arange(1, wanted + 1)
    while True:
        middle = (below + above) / 2
        if ((middle <= below) | (middle >= above)).all():
            return middle
        enough = count_above(diagonal, sides, middle) >= places
        below, above = np.where(enough, middle, below), np.where(enough, above, middle)


def intervals(values: np.ndarray, wanted: int, high: float, size: float) -> list[tuple[float, float]]:
    """Intervals, from the top, that cover the first ``wanted`` of some falling eigenvalues and end in gaps.

    ``values`` holds one more where there is one. Values closer than rounding can tell apart stay together.
    """
    found, top, start = [], high, 0
    for i in range(len(values)):
        after = values[i + 1] if i + 1 < len(values) else values[i] - max(size, high - values[i])
        if values[i] - after <= 1e-9 * size:
            continue
        full = i + 1 - start >= PER_INTERVAL or i + 1 >= wanted
        if full:
            end = (values[i] + after) / 2
            found.append((end, top))
            top, start = end, i + 1
        if i + 1 >= wanted:
            break
    return found


def project(spark: SparkSession, matrix: np.ndarray, sought: list[tuple[int, float, float, np.ndarray]]) -> dict[int, np.ndarray]:
    """The contour integrals of some (number, low, high, start vectors): one Spark row per quadrature point.

    The matrix and the vectors are as large as the vectors are long, never as many.
    """
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 - nodes)
    rows = []
    for number, low, high, start in sought:
        centre, radius = (low + high) / 2, (high - low) / 2
        for angle, weight in zip(angles, weights, strict=True):
            turn = radius * np.exp(1j * angle)
            point, share = complex(centre + turn), complex(weight * turn / 2)
            rows.append((number, point.real, point.imag, share.real, share.imag, start.tobytes(), start.shape[1]))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                start = np.frombuffer(row.start).reshape(len(matrix), row.width)
                shifted = complex(row.re, row.im) * np.eye(len(matrix)) - matrix
                out.append((row.number, (complex(row.wre, row.wim) * np.linalg.solve(shifted, start)).real.tobytes()))
            yield pd.DataFrame(out, columns=["number", "part"])

    points = spark.createDataFrame(rows, "number int, re double, im double, wre double, wim double, start binary, width int")
    parts = points.repartition(min(len(rows), spark.sparkContext.defaultParallelism)).mapInPandas(solve, "number int, part binary")
    found: dict[int, np.ndarray] = {}
    for number, held in parts.orderBy("number", F.xxhash64("part")).collect():  # intervals x points
        shape = next(s[3].shape for s in sought if s[0] == number)
        found[number] = found.get(number, 0) + np.frombuffer(held).reshape(shape)
    return found


def ritz(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in the span of some vectors: values, falling, and unit vectors."""
    basis = np.linalg.qr(vectors)[0]
    values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
    return values[::-1], basis @ turned[:, ::-1]


def leading(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns, to double precision.

    Of equal eigenvalues any orthonormal vectors are given. Raises if the counts and the pairs found disagree.
    """
    n = len(matrix)
    wanted = min(wanted, n)
    size = float(np.abs(matrix).sum(axis=1).max())  # no eigenvalue is larger
    if not wanted or not size:
        return np.zeros(wanted), np.eye(n)[:, :wanted]
    diagonal, sides = tridiagonal(matrix)
    high, low = size * (1 + 1e-9), -size * (1 + 1e-9)
    # One more than wanted, and all that are equal to the last, so that the last interval ends in a gap.
    asked = min(n, wanted + 1)
    while asked < n:
        values = bisect(diagonal, sides, asked, low, high)
        if values[wanted - 1] - values[-1] > 1e-9 * size:
            break
        asked = min(n, 2 * asked)
    values = bisect(diagonal, sides, asked, low, high)
    cut = intervals(values, wanted, high, size)
    ends = np.array([[a, b] for a, b in cut])
    held = count_above(diagonal, sides, ends[:, 0]) - count_above(diagonal, sides, ends[:, 1])
    chance = np.random.default_rng(0)
    widths = {i: min(n, int(max(2 * c, c + 6))) for i, c in enumerate(held)}
    starts = {i: chance.standard_normal((n, width)) for i, width in widths.items()}
    done: dict[int, np.ndarray] = {}
    for round_ in range(ROUNDS):
        sums = project(spark, matrix, [(i, *cut[i], np.ascontiguousarray(start)) for i, start in starts.items()])
        for i, projected in sums.items():
            values, vectors = ritz(matrix, projected)
            inside = (values > cut[i][0]) & (values < cut[i][1])
            wrong = np.linalg.norm(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if (wrong <= EXACT * size).sum() == held[i] == inside.sum():
                done[i] = vectors[:, inside]
                del starts[i]
            else:  # what stays short of the count, or converges slowly, gets a larger space
                more = min(n, 2 * widths[i]) if round_ % 5 == 4 else widths[i]
                starts[i] = np.c_[vectors, chance.standard_normal((n, more - widths[i]))]
                widths[i] = more
        if not starts:
            break
    else:
        raise ArithmeticError(f"no {held.tolist()} eigenpairs in {cut}")
    # Intervals are solved apart; one more Rayleigh-Ritz over all of them makes their vectors orthogonal to rounding.
    values, vectors = ritz(matrix, np.concatenate([done[i] for i in range(len(cut))], axis=1))
    return values[:wanted], vectors[:, :wanted]
