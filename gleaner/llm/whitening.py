"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The centred rows are a tall matrix A.  A step takes a unit vector v, forms u = A v, takes its part along the
earlier u off, and the next v is what is new in A'u.  Then A V = U R with R upper bidiagonal, and the singular
values and right vectors of the small R give the components and their deviations.

u is as long as the table and never stored.  A row's entries in all the u so far follow from the row,
V and R by the same recurrence that made them, so a task works them out anew for its rows: a pass reads the rows
once and adds up u'u, U'u and A'u.  Both sides are fully orthogonalised against all earlier vectors: v on the
driver, u from U'u; where that shows more than rounding, the step is passed over again.  What the corrections
put above R's two diagonals is rounding as well, and is kept in the small decomposition.

As many steps are made as there are dimensions, so that components that lie close together are parted, too.
Where the vectors run out early (equal or zero singular values), a fresh direction goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.vectors import EXACT, matrix, widened
from gleaner.session import Steps, small_batches

BLOCK_BYTES = 1 << 15  # vectors packed into one row
ORTHOGONAL = 1e-10  # a step whose u has more than this share along earlier ones is passed over again
GONE = 1e-11  # a vector of less than this share of the largest singular value seen has nothing new
LONGEST = (1 << 63) - 1


class Rows(NamedTuple):
    """Packed vectors, their number, dimensions and the exact sums."""

    packed: DataFrame
    n: int
    sums: list[int]

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as a whole number and a rest below one."""
        return (np.array([s // self.n for s in self.sums], np.float64),
                np.array([s % self.n / self.n for s in self.sums]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = np.clip(matrix(batch.column(1)), -EXACT, EXACT)
        size = max(1, BLOCK_BYTES // (8 * max(1, whole.shape[1])))
        for low in range(0, batch.num_rows, size):
            x = whole[low:low + size]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0).slice(low, size).to_pylist()], pa.list_(pa.int64())),
                 pa.array([x.shape[1]], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["ids", "dims", "data"])


def _unpacked(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch of packed rows (…, dims, data)."""
    parts = [widened(np.frombuffer(data).reshape(-1, d) if d else np.zeros((n, 0)), dims) for n, d, data in zip(
        batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
    return np.concatenate(parts) if parts else np.zeros((0, dims))


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = [0] * dims, [0] * dims
        for batch in batches:
            x = _unpacked(batch, dims).astype(np.int64)
            # two halves, whose sums stay within a long for as many rows as a batch can hold
            high = [a + int(b) for a, b in zip(high, (x >> 26).sum(0), strict=True)]
            low = [a + int(b) for a, b in zip(low, (x & (1 << 26) - 1).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[str((a << 26) + b) for a, b in zip(high, low, strict=True)]])], names=["part"])
    return run


def _summed(rows: DataFrame, dims: int, work: Callable, of: str) -> dict[int, float | Decimal]:
    """By place, the sums of the arrays that the tasks give."""
    parts = rows.select(F.size("ids").alias("n"), "dims", "data").mapInArrow(work, "part array<string>" if of != "double" else "part array<double>")
    placed = parts.select(F.posexplode("part").alias("at", "value"))
    return dict(map(tuple, placed.groupBy("at").agg(F.sum(F.col("value").cast(of))).collect()))


def _adder(centre: tuple[np.ndarray, np.ndarray], size: int, of: Callable[[np.ndarray], np.ndarray]):
    """Adds up of(centred rows) over a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(_unpacked(batch, len(centre[0])) - centre[0] - centre[1])
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["part"])
    return run


def _left(v: np.ndarray, r: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' entries in the u of the first columns of r, and in A times the last v."""
    products = a @ v
    u = np.zeros((len(a), r.shape[1]))
    for i in range(r.shape[1]):
        if r[i, i]:
            u[:, i] = (products[:, i] - u[:, :i] @ r[:i, i]) / r[i, i]
    return u, products[:, -1]


def bidiagonalise(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """V and R of the centred rows, of as many columns as there are dimensions."""
    dims, centre = len(rows.sums), rows.centre
    draw = np.random.default_rng(1)
    v, r, z = np.zeros((dims, 0)), np.zeros((0, 0)), np.zeros((dims, 0))

    def fresh() -> np.ndarray:
        w = draw.normal(size=dims)
        for _ in range(3):
            w -= v @ (v.T @ w)
            w /= np.linalg.norm(w)
        return w

    following, beta, largest = fresh(), 0.0, 0.0
    for k in range(dims):
        v = np.column_stack([v, following])
        h = np.zeros(k)
        if k:
            h[-1] = beta
        for _ in range(3):
            def of(a: np.ndarray, v=v, r=r, h=h) -> np.ndarray:
                u, product = _left(v, r, a)
                new = product - u @ h
                return np.concatenate([[new @ new], u.T @ new, a.T @ new])

            found = _summed(rows.packed, dims, _adder(centre, 1 + k + dims, of), "double")
            found = np.array([found.get(i, 0.0) for i in range(1 + k + dims)])
            square, along, back = found[0], found[1:1 + k], found[1 + k:]
            h = h + along
            back = back - z @ along
            alpha = np.sqrt(max(square - along @ along, 0.0))
            if np.linalg.norm(along) <= ORTHOGONAL * alpha or alpha <= GONE * largest:
                break
        if alpha <= GONE * largest:
            alpha, back = 0.0, np.zeros(dims)
        else:
            back = back / alpha
        largest = max(largest, alpha, beta)
        r = np.block([[r, h[:, None]], [np.zeros((1, k)), np.array([[alpha]])]])
        z = np.column_stack([z, back])
        if k + 1 < dims:
            w = back - alpha * v[:, -1]
            for _ in range(2):
                w = w - v @ (v.T @ w)
            beta = float(np.linalg.norm(w))
            following = w / beta if beta > GONE * largest and beta else fresh()
            if beta <= GONE * largest:
                beta = 0.0
    return v, r


def principal(rows: Rows, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and as many leading unit eigenvectors as asked and not of value zero."""
    v, r = bidiagonalise(rows)
    _, values, right = np.linalg.svd(r)
    sure = values > values[0] * GONE
    vectors = v @ right[sure][:most].T
    return values**2 / rows.n, vectors / np.linalg.norm(vectors, axis=0)


def _deviations(x: np.ndarray, rows: int, sums: list[int]) -> np.ndarray:
    """Exact sums over the dimensions of (rows * x - sums) ** 2; beyond a long the largest long."""
    whole, rest = np.array([s // rows for s in sums], np.float64), [s % rows for s in sums]
    near = x - whole
    guess = ((rows * (np.abs(near) + 1)) ** 2).sum(1)
    out = np.zeros(len(x), np.int64)
    small = guess < 2.0**62
    out[small] = ((rows * near[small].astype(np.int64) - np.array(rest, np.int64)) ** 2).sum(1) if small.any() else 0
    for i in np.flatnonzero(~small).tolist():
        out[i] = min(LONGEST, sum((rows * int(a) - s) ** 2 for a, s in zip(x[i].tolist(), sums, strict=True)))
    return out


def _whitened(rows: Rows, project: np.ndarray, explained: np.ndarray, error: float):
    centre, n, sums = rows.centre, rows.n, rows.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.concat_arrays([batch.column(3).flatten()])
            x = _unpacked(batch, len(sums))
            deviations = _deviations(x, n, sums)
            out = (x - centre[0] - centre[1]) @ project
            count = out.shape[1]
            for low in range(0, len(x), 10_000):
                part = slice(low, low + 10_000)
                size = len(x[part])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, size).take(pa.array(np.repeat(np.arange(size), count))),
                     pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)), pa.array(np.full(size * count, n)),
                     pa.array(np.repeat(deviations[part], count)), pa.array(out[part].ravel()),
                     pa.array(np.tile(explained, size)), pa.array(np.full(size * count, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, components: int, steps: Steps) -> DataFrame:
    """Rows vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    vectors holds vec_id and x, an array of whole numbers as doubles.  All of them are fitted:
    components are unit eigenvectors of the covariance (divisor n) by falling eigenvalue, whitened is the centred
    vector's projection over the root of the eigenvalue, explained the eigenvalue's share of the trace.
    deviation is the sum over the dimensions of (n * x - sum) ** 2, exactly; beyond a long it is the
    largest long.  identity_error is the largest absolute entry of whitened's covariance minus the identity.

    Shorter vectors count as having zeros at their end; entries beyond 2^53 count as that.  Rows that repeat an id, or
    have none, are rows like others.  Only components with an eigenvalue above zero come out, so one
    row, equal rows, vectors without entries and an empty table give an empty result.

    A pass over the packed rows a dimension, a few more for sums, check and result; two numbers a dimension
    and one a step come back to the driver, which holds a square matrix of the dimensions.
    """
    small_batches(vectors.sparkSession)
    fields = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    packed = steps.keep(vectors.select("vec_id", "x").mapInArrow(_packed, "ids array<long>, dims long, data binary"))
    size = packed.agg(F.sum(F.size("ids")).alias("n"), F.max("dims").alias("dims")).first()
    n, dims = size["n"] or 0, size["dims"] or 0
    if n < 2 or not dims:
        return vectors.sparkSession.createDataFrame([], fields)
    sums = _summed(packed, dims, _sums(dims), "decimal(38,0)")
    rows = Rows(packed, n, [int(sums[i]) for i in range(dims)])
    values, leading = principal(rows, components)
    if not leading.shape[1]:
        return vectors.sparkSession.createDataFrame([], fields)
    count = leading.shape[1]
    project = leading / np.sqrt(values[:count])

    means = _summed(packed, dims, _adder(rows.centre, count, lambda a: (a @ project).sum(0)), "double")
    mean = np.array([means[i] for i in range(count)]) / n

    def product(a: np.ndarray) -> np.ndarray:
        w = a @ project - mean
        return (w.T @ w).ravel()

    products = _summed(packed, dims, _adder(rows.centre, count * count, product), "double")
    covariance = np.array([products[i] for i in range(count * count)]).reshape(count, count) / n
    error = float(np.abs(covariance - np.eye(count)).max())
    return packed.select(F.size("ids").alias("n"), "dims", "data", "ids").mapInArrow(
        _whitened(rows, project, values[:count] / values.sum(), error), fields)
