"""Whitening of vectors by their leading principal components, found by FEAST contour integration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import checkpointed

#: A component c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000

#: Components that are extracted, at most.
COMPONENTS = 16

#: Eigenvalues that an interval is meant to hold, at most; quadrature points on a half circle.
PER_INTERVAL, POINTS = 6, 8

#: How many times its lower end the upper end of an interval may be.
REACH = 4

#: Scaled values are kept inside this bound, so that sums of a table fit into Python's and Decimal's integers.
_BOUND = 2**62


def _reduced(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the same inertia at every shift (Householder)."""
    a, n = matrix.copy(), len(matrix)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        w = p - (x @ p) * x
        rest -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0])
    return np.diag(a).copy(), np.diag(a, 1).copy()


class Spectrum:
    """Inertia counts of a symmetric matrix: how many eigenvalues lie above a shift, by the signs of L D L^T."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.d, self.e = _reduced(matrix)
        self.squares = (self.e**2).tolist()
        reach = np.r_[0, np.abs(self.e)] + np.r_[np.abs(self.e), 0]
        self.low, self.high = float(np.min(self.d - reach)), float(np.max(self.d + reach))
        self.scale = max(abs(self.low), abs(self.high), float(np.finfo(float).tiny))

    def above(self, shift: float) -> int:
        tiny, count, pivot = float(np.finfo(float).eps) * self.scale, 0, 1.0
        for i, d in enumerate(self.d.tolist()):
            pivot = d - shift - (self.squares[i - 1] / pivot if i else 0.0)
            if abs(pivot) < tiny:
                pivot = -tiny
            count += pivot > 0
        return count

    def border(self, wanted: int, low: float, high: float, above_it: bool = False) -> float:
        """A shift in (low, high) with ``wanted`` eigenvalues above it, in the middle of its gap.

        Of a cluster that cannot be parted the shift is below all members. With ``above_it`` the shift is
        just above the ``wanted``-th eigenvalue instead.
        """
        for _ in range(200):
            middle = (low + high) / 2
            if not low < middle < high or high - low < 1e-13 * self.scale or above_it and high - low < 1e-3 * high:
                break
            have = self.above(middle)
            if have == wanted and not above_it:
                return self.widened(middle, low, high)
            low, high = (middle, high) if have >= wanted else (low, middle)
        return high if above_it else low

    def widened(self, inside: float, low: float, high: float) -> float:
        """The middle of the gap around a shift, looked for in (low, high), so that no border lies next to an eigenvalue."""
        ends, wanted = [], self.above(inside)
        for far in (low, high):
            near = inside
            for _ in range(20):
                middle = (near + far) / 2
                near, far = (middle, far) if self.above(middle) == wanted else (near, middle)
            ends.append(near)
        return sum(ends) / 2


def intervals(matrix: np.ndarray, k: int, per_interval: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """Adjoining intervals (low, high, eigenvalues inside) that hold the ``k`` largest eigenvalues above the noise."""
    spectrum = Spectrum(matrix)
    noise = len(matrix) * float(np.finfo(float).eps) * 8 * spectrum.scale
    real = min(k, spectrum.above(noise))
    high = spectrum.high + 1e-6 * spectrum.scale
    out, done = [], 0
    while done < real:
        # hug the largest eigenvalue that is left, then stay within a factor of it: far smaller ones get circles of their own
        high = min(high, 1.01 * spectrum.border(done + 1, noise / 2, high, above_it=True))
        low = spectrum.border(min(done + per_interval, real), noise / 2, high)
        if low < high / REACH:
            low = spectrum.widened(high / REACH, high / REACH / 2, high)
        inside = spectrum.above(low) - done
        if inside > 0:
            out.append((low, high, inside))
            done += inside
        high = low
    return out


def _contour(matrix: np.ndarray, low: float, high: float, inside: int, size: int, points: int):
    """The eigenpairs that a subspace of ``size`` columns yields: largest residual, values, vectors; None if not ``inside``."""
    n = len(matrix)
    space = np.random.default_rng(7).standard_normal((n, size))
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(points)
    turns = np.exp(1j * np.pi * (1 + nodes) / 2)
    scale, best = np.abs(matrix).sum(axis=1).max(), None
    for _ in range(30):
        projected = np.zeros_like(space)
        for turn, weight in zip(turns, weights, strict=True):
            solved = np.linalg.solve((centre + radius * turn) * np.eye(n) - matrix, space)
            projected += (weight / 2 * radius * turn * solved).real
        base, _ = np.linalg.qr(projected)
        small = base.T @ matrix @ base
        values, turned = np.linalg.eigh((small + small.T) / 2)
        space = base @ turned
        picked = (values > low) & (values <= high)
        if picked.sum() != inside:
            continue
        residual = np.linalg.norm(matrix @ space[:, picked] - space[:, picked] * values[picked], axis=0).max()
        if best is not None and residual >= best[0] / 2 and best[0] < 1e-12 * scale:
            break
        if best is None or residual < best[0]:
            best = residual, values[picked], space[:, picked]
    return best if best is not None and best[0] < 1e-10 * scale else None


def feast(matrix: np.ndarray, low: float, high: float, inside: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenvalues in (low, high], falling, and their unit vectors, by a contour around the interval.

    A subspace is multiplied by the quadrature of (z - V)^-1 on a circle through the ends (Gauss-Legendre points
    of the upper half; the lower half is conjugate), and Rayleigh-Ritz takes eigenpairs from it, again and again.
    Where too many eigenvalues lie just outside, a wider subspace is taken. The eigenpairs must be as many
    as the inertia counts say, else an error is raised.
    """
    size = min(len(matrix), inside + max(4, inside))
    while True:
        found = _contour(matrix, low, high, inside, size, points)
        if found is not None:
            order = np.argsort(-found[1])
            return found[1][order], found[2][:, order]
        if size == len(matrix):
            raise ArithmeticError(f"{inside} eigenvalues lie in ({low}, {high}]; the contour did not find them")
        size = min(len(matrix), 2 * size)


def components(spark, matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues above the noise, falling, and their unit vectors as columns.

    Each interval of the spectrum is a row, solved in a task of its own; intervals do not depend on each other.
    """
    slices = [(i, *x) for i, x in enumerate(intervals(matrix, k))]
    if not slices:
        return np.empty(0), np.empty((len(matrix), 0))
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, vectors = feast(shared.value, row["low"], row["high"], row["inside"])
                rows = pa.array([row["part"]] * len(values), pa.int32())
                yield pa.record_batch([rows, pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], ["part", "value", "vector"])

    asked = spark.createDataFrame(slices, "part int, low double, high double, inside int").repartition(len(slices), "part")
    found = sorted(asked.mapInArrow(run, "part int, value double, vector array<double>").collect(), key=lambda r: -r.value)[:k]
    vectors = np.array([r.vector for r in found]).T
    # intervals are solved apart; what rounding leaves between them is taken out in order
    base, upper = np.linalg.qr(vectors)
    vectors = base * np.sign(np.diag(upper))
    return np.einsum("ij,ik,kj->j", vectors, matrix, vectors), vectors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as rows; all have ``width`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _scaled(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x`` of the rows that take part, with x the scaled whole numbers."""
    entries = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~odd)
    bound = F.lit(float(_BOUND))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, -bound), bound)) + F.lit(SHIFT).cast("long")).alias("x"))


def _summed(rows: DataFrame, run, width: int) -> np.ndarray:
    """The sum over all tasks of the matrix that ``run`` makes of a task's vectors, ``width`` columns wide."""

    def rowwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = run(batch.column(0))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.mapInArrow(rowwise, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((1 + max((c.i for c in cells), default=-1), width))
    for c in cells:
        out[c.i, c.j] = c.v
    return out


def _sums(fit: DataFrame, width: int) -> list[int]:
    """The exact sum of each dimension, whatever its size: high and low halves are added apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(high), pa.array(low)], ["i", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    found = fit.mapInArrow(run, "i int, high long, low long").groupBy("i").agg(*wide).collect()
    out = [0] * width
    for r in found:
        out[r.i] = (int(r.high) << 32) + int(r.low)
    return out


def _deviations(off: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * off - rest)^2 for each row, exact; null where a long cannot hold it."""
    most = n * int(np.abs(off).max(initial=0)) + max(map(abs, rest), default=0)
    if most * most * max(1, len(rest)) < 2**63:
        apart = n * off - np.array(rest, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * x - r) ** 2 for x, r in zip(row, rest, strict=True)) for row in off.tolist()]
    return [x if x < 2**63 else None for x in exact]


_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Project vectors on their ``k`` leading principal components, scaled to unit variance.

    Returns ``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component.
    An entry c becomes x = floor(64 c) + 1000000. The fit list has each distinct x once: n vectors with sums S.
    ``deviation`` is the sum over dimensions of (n x - S)^2; ``explained`` the component's share of all variance;
    ``identity_error`` how far the covariance of the whitened fit list, measured over it, is from the identity.

    1. Distinct vectors are written; tasks add up exact sums, then products of centred vectors, dimension by
       dimension. Centring takes a whole number off exactly before the rest, so that far means cost no digits.
    2. The spectrum of the covariance is cut into intervals by inertia counts, each interval is solved by a
       contour integral in a task of its own, and its eigenpairs must be as many as the counts say.
    3. Tasks project all rows.

    Vectors that are null, empty or hold null or non-finite entries take no part; nor do those of another length
    than most (of equally many, the longer). Scaled entries beyond 2^62 count as 2^62; a deviation that a long
    cannot hold is null. Components whose eigenvalue is rounding noise do not exist, so vectors that are all equal
    have none and an empty table gives no rows. Repeated rows and identifiers each get rows of their own. Other
    columns are not looked at.
    """
    spark = df.sparkSession
    rows = _scaled(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = lengths.width if lengths else 1
    rows = rows.where(F.size("x") == width)
    fit = checkpointed(rows.select("x").distinct())
    n = fit.count()
    if n == 0:
        return spark.createDataFrame([], _DDL)
    sums = _sums(fit, width)
    whole = [(2 * s + n) // (2 * n) for s in sums]  # the nearest whole number to the mean
    rest = [s - n * w for s, w in zip(sums, whole, strict=True)]
    base, fraction = np.array(whole, np.int64), np.array([r / n for r in rest])

    def centred(column: pa.Array) -> np.ndarray:
        return (_matrix(column, width) - base) - fraction

    def product(column: pa.Array) -> np.ndarray:
        z = centred(column)
        return z.T @ z

    covariance = _summed(fit, product, width) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = components(spark, covariance, k)
    scaled = vectors / np.sqrt(values)
    count = len(values)
    explained = (values / np.trace(covariance)).tolist() if count else []

    def measured(column: pa.Array) -> np.ndarray:
        w = centred(column) @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    error = None
    if count:
        found = _summed(fit, measured, count) / n
        error = float(np.abs(found[:count] - np.outer(found[count], found[count]) - np.eye(count)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = _matrix(batch.column("x"), width) - base
            w = (off - fraction) @ scaled
            deviations, ids, m = _deviations(off, n, rest), batch.column("vec_id"), batch.num_rows
            each = np.repeat(np.arange(m), count)
            yield pa.record_batch(
                [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * count, n, np.int64)),
                    pa.array(deviations, pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel()),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * count), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, _DDL)
