"""Whitening of embeddings by components that FEAST finds.

1. Vectors become exact whole numbers ``x``. One pass adds up their number and sums, a second one
   the products of ``x`` less the rounded mean. Both add whole numbers, map side first, so
   the covariance is the exactly rounded one whatever the partitions.
2. The spectrum is cut into intervals by bisection on inertia: of ``T - s I``, factored as
   ``L D L'`` with ``T`` a tridiagonal matrix similar to ``V``, as many pivots in ``D`` are positive
   as ``V`` has eigenvalues above ``s`` (Sylvester).
3. Each interval is a row of a table and a task of its own: contour integration around it, that
   is a quadrature of solves with the complex shifted matrix, filters a random subspace, a
   Rayleigh-Ritz step gives its eigenpairs, and both repeat until the residuals are at rounding.
   The number found must be the one that inertia counts; else the subspace grows.
4. Rows are projected on the components. Their covariance is measured on all rows.

Only the d x d matrix, d the number of dimensions, and one row per interval and component pass
through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlake.llm.common import col, ship_by_value

ship_by_value(__name__)

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this count as non-finite: their whole numbers would not be exact.
LARGEST = float(1 << 40)
#: Quadrature points in the upper half of the contour, and most eigenvalues of an interval.
NODES, PER_INTERVAL = 8, 4
#: Eigenvalues below this share of the largest one are rounding, and count as 0.
RANK = 1e-13
ROUNDS = 40
LONG = (1 << 63) - 1


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """``floor(1024 c) + 100000`` of the entries of vectors without nulls, one row per vector; a
    vector that is shorter than the longest one of the batch is filled up with entries of 0."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()].to_numpy(zero_copy_only=False).astype(np.float64)
    widest = int(lengths.max()) if len(lengths) else 0
    out = np.full((len(lengths), widest), SHIFT, np.int64)
    out[np.arange(widest) < lengths[:, None]] = np.floor(flat * SCALE).astype(np.int64) + SHIFT
    return out


def widened(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])), constant_values=SHIFT)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of the rows whose vector is there and has only finite entries."""
    rows = vectors.select(col(id_col).alias("vec_id"), col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.forall("vector", lambda c: F.coalesce(F.abs(c) < F.lit(LARGEST), F.lit(False)) & ~F.isnan(c)))


def exact_sum(values: np.ndarray) -> list[int]:
    """Column sums of whole numbers without overflow."""
    if values.size and len(values) * int(np.abs(values).max()) <= LONG:
        return values.sum(axis=0).tolist()
    return [sum(c) for c in zip(*values.tolist(), strict=True)]


def exact_products(y: np.ndarray) -> list[list[int]]:
    """``y' y`` of whole numbers, exact: in doubles where every sum stays below 2**53."""
    most = int(np.abs(y).max()) if y.size else 0
    if most * most * len(y) < 1 << 53:
        return (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64).tolist()
    wide = y.astype(object)
    return (wide.T @ wide).tolist()


def added(rows: DataFrame, task, key: str) -> dict[int, int]:
    """The sums by place of the partial sums ``place, value`` that tasks yield."""
    parts = rows.mapInArrow(task, "place int, value decimal(38, 0)")
    return {r[0]: int(r[1]) for r in parts.groupBy("place").agg(F.sum("value").cast("decimal(38, 0)").alias(key)).collect()}


def partial(places: list[int], values: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], names=["place", "value"])


@dataclass(frozen=True)
class Moments:
    """Number of vectors, exact sums ``S`` by dimension, and the covariance (divisor n)."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray


def moments(rows: DataFrame) -> Moments:
    """Exact moments of the vectors in two passes. The second one multiplies what is left after the
    rounded mean is taken off, so nothing cancels; what rounding left of the mean is exact too."""
    dims = rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                own = exact_sum(widened(whole_numbers(batch.column("vector")), dims))
                sums = [a + b for a, b in zip(sums, own, strict=True)]
        if n:
            yield partial([*range(dims), dims], [*sums, n])

    total = added(rows, count, "sum")
    n = total.get(dims, 0)
    sums = tuple(total.get(d, 0) for d in range(dims))
    if not n:
        return Moments(0, sums, np.zeros((dims, dims)))
    centre = [(2 * s + n) // (2 * n) for s in sums]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((dims, dims), object)
        first = [0] * dims
        seen = False
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 13):
                y = widened(whole_numbers(batch.column("vector").slice(lo, 1 << 13)), dims) - np.array(centre, np.int64)
                products += np.array(exact_products(y), object)
                first = [a + b for a, b in zip(first, exact_sum(y), strict=True)]
                seen = True
        if seen:
            upper = np.triu_indices(dims)
            yield partial([*(upper[0] * dims + upper[1]).tolist(), *range(dims * dims, dims * dims + dims)], [*products[upper].tolist(), *first])

    total = added(rows, multiply, "sum")
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            exact = n * total[i * dims + j] - total[dims * dims + i] * total[dims * dims + j]
            covariance[i, j] = covariance[j, i] = exact / (n * n)
    return Moments(n, sums, covariance)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared side diagonal of an orthogonally similar tridiagonal matrix."""
    a = matrix.copy()
    for k in range(len(a) - 2):
        column = a[k + 1 :, k]
        length = np.linalg.norm(column)
        if not length:
            continue
        mirror = column / length
        mirror[0] += math.copysign(1.0, mirror[0])
        mirror /= np.linalg.norm(mirror)
        a[k + 1 :, k:] -= 2 * np.outer(mirror, mirror @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ mirror, mirror)
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def inertia_above(diagonal: np.ndarray, side: np.ndarray, shift: float) -> int:
    """The number of eigenvalues above ``shift``: that of positive pivots of the shifted
    tridiagonal matrix."""
    tiny = np.finfo(float).tiny * 1e8
    positive, pivot = 0, 1.0
    for d, b in zip((diagonal - shift).tolist(), [0.0, *side.tolist()], strict=True):
        pivot = d - b / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        positive += pivot > 0
    return positive


class Spectrum:
    """Places of eigenvalues by bisection on inertia; every count made serves all later ones."""

    def __init__(self, matrix: np.ndarray):
        self.bands = tridiagonal(matrix)
        self.top = float(np.abs(matrix).sum(axis=1).max(initial=0)) * (1 + 1e-12)
        self.floor = RANK * self.top
        self.rank = inertia_above(*self.bands, self.floor) if self.top else 0
        self.counts = {self.floor: self.rank, self.top: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = inertia_above(*self.bands, shift)
        return self.counts[shift]

    def around(self, k: int) -> tuple[float, float]:
        """Bounds of the k-th largest eigenvalue, which are close together; 0 beyond the rank."""
        if k > self.rank:
            return 0.0, self.floor
        low = max(s for s, c in self.counts.items() if c >= k)
        high = min(s for s, c in self.counts.items() if c < k)
        while high - low > 1e-6 * high:
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)
        return low, high


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals ``(low, high, eigenvalues inside)`` from the top that hold the ``wanted`` largest
    eigenvalues that are not 0. An interval ends in the middle of the widest gap that follows one of
    its first ``PER_INTERVAL`` eigenvalues, because a contour next to an eigenvalue converges
    slowly; eigenvalues that bisection does not tell apart stay together."""
    spectrum = Spectrum(matrix)
    wanted = min(wanted, spectrum.rank)
    out, high, above = [], spectrum.top, 0
    while above < wanted:
        places = [spectrum.around(above + 1)]
        best = None
        while best is None:
            places.append(spectrum.around(above + len(places) + 1))
            if len(places) > PER_INTERVAL or above + len(places) > spectrum.rank:
                widths = [(p[0] - q[1]) / p[0] for p, q in zip(places[:-1], places[1:], strict=True)]
                k = int(np.argmax(widths))
                if widths[k] > 0:
                    best = k
        low = max(spectrum.floor, (places[best][0] + places[best + 1][1]) / 2)
        found = spectrum.above(low)
        out.append((low, high, found - above))
        high, above = low, found
    return out


def feast(matrix: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues in the interval and their unit eigenvectors (columns), falling."""
    dims = len(matrix)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    angles = (points + 1) * math.pi / 2
    centre, radius = (low + high) / 2, (high - low) / 2
    eye = np.eye(dims)
    scale = float(np.abs(matrix).max())
    size = min(dims, inside + max(4, inside // 2))
    rng = np.random.default_rng(inside)
    while True:
        basis = rng.standard_normal((dims, size))
        values, vectors, error = np.zeros(0), basis[:, :0], math.inf
        for _ in range(ROUNDS):
            filtered = np.zeros((dims, size))
            for angle, weight in zip(angles, weights, strict=True):
                on_circle = radius * np.exp(1j * angle)
                solved = np.linalg.solve((centre + on_circle) * eye - matrix, basis.astype(complex))
                filtered += (weight / 2) * (on_circle * solved).real
            orthogonal, _ = np.linalg.qr(filtered)
            small = orthogonal.T @ matrix @ orthogonal
            ritz, inner = np.linalg.eigh((small + small.T) / 2)
            basis = orthogonal @ inner
            chosen = np.nonzero((ritz > low) & (ritz <= high))[0][::-1]
            values, vectors = ritz[chosen], basis[:, chosen]
            last = error
            error = float(np.abs(matrix @ vectors - vectors * values).max()) if len(chosen) else math.inf
            if len(chosen) == inside and error >= last / 2 and error <= 1e-13 * scale * dims:
                return values, vectors
        if size == dims:
            return values, vectors
        size = min(dims, 2 * size)


def components(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues that are not 0, falling, and their eigenvectors (columns);
    one task per interval. Raises if an interval has others than inertia counts."""
    cuts = intervals(matrix, wanted)
    if not cuts:
        return np.zeros(0), np.zeros((len(matrix), 0))
    rows = spark.createDataFrame([(k, lo, hi, n) for k, (lo, hi, n) in enumerate(cuts)], "part int, low double, high double, inside int")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values, vectors = feast(matrix, r["low"], r["high"], r["inside"])
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * len(values), pa.int32()), pa.array(values), pa.array(vectors.T.tolist(), kind)], names=["part", "value", "vector"])

    found = rows.repartition(len(cuts), "part").mapInArrow(task, "part int, value double, vector array<double>").collect()
    for k, (low, high, inside) in enumerate(cuts):
        if sum(r.part == k for r in found) != inside:
            raise ArithmeticError(f"{inside} eigenvalues between {low} and {high}, but not as many found")
    # One more Rayleigh-Ritz step over all of them makes vectors of different intervals orthogonal.
    orthogonal, _ = np.linalg.qr(np.array([r.vector for r in found]).T)
    small = orthogonal.T @ matrix @ orthogonal
    values, inner = np.linalg.eigh((small + small.T) / 2)
    return values[::-1][:wanted], (orthogonal @ inner)[:, ::-1][:, :wanted]


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """``sum (n x - S)^2`` of each row, exact; None where a long cannot hold it."""
    if n * (int(np.abs(x).max()) if x.size else 0) < 1 << 62 and all(abs(s) < 1 << 62 for s in sums):
        apart = n * x - np.array(sums, np.int64)
        most = int(np.abs(apart).max()) if apart.size else 0
        if most * most * x.shape[1] <= LONG:
            return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v <= LONG else None for v in exact]


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    wanted: int = COMPONENTS,
) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``.

    Vectors that are null, or have entries that are null, not finite or beyond 2**40, take no part.
    An entry c becomes ``x = floor(1024 c) + 100000``; a shorter vector is filled up with
    entries of 0. ``component`` counts from 1 by falling eigenvalue of the covariance of x; there
    are at most ``wanted``, the number of dimensions, and the rank of the covariance, so equal
    vectors alone have no components and give no rows. ``deviation`` is null where a long cannot hold
    it. Eigenvectors of equal eigenvalues are any orthogonal ones, the same for all rows.
    Repeated rows and rows without an id are answered each; an empty table gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    known = moments(rows)
    n, sums, dims = known.n, known.sums, len(known.sums)
    kind = dict(rows.dtypes)["vec_id"]
    values, axes = components(spark, known.covariance, min(wanted, dims))
    count = len(values)
    if not count:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    # The mean as a whole number and a rest: x less the whole number is exact.
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)])
    scaled = axes / np.sqrt(values)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - rest) @ scaled

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, products = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            if batch.num_rows:
                w = projected(widened(whole_numbers(batch.column("vector")), dims))
                first += w.sum(axis=0)
                products += w.T @ w
        flat = np.concatenate([products.ravel(), first])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["place", "value"])

    total = {r[0]: r[1] for r in rows.mapInArrow(measure, "place int, value double").groupBy("place").agg(F.sum("value")).collect()}
    flat = np.array([total[k] for k in range(count * count + count)]) / n
    mean = flat[count * count :]
    identity_error = float(np.abs(flat[: count * count].reshape(count, count) - np.outer(mean, mean) - np.eye(count)).max())
    explained = values / math.fsum(np.diag(known.covariance))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(lo, 1 << 13)
                x = widened(whole_numbers(part.column("vector")), dims)
                size = len(x)
                columns = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(size), count))),
                    pa.array(np.tile(np.arange(1, count + 1), size), pa.int32()),
                    pa.array(np.full(size * count, n), pa.int64()),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(size), count))),
                    pa.array(projected(x).ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * count, identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(task, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
