"""Whitening of embeddings by spectral divide and conquer.

Entries become whole numbers first, so their sums and the sums of products of
centred entries are exact: the covariance doesn't depend on how Spark deals the
rows. It is split by QDWH: the polar factor of the covariance minus a shift has
the eigenvalues 1 and -1, so half of it plus the identity projects on the
subspace of the eigenvalues above the shift. Bases of that subspace and of the
rest split the matrix into two smaller ones, which are split again, until every
part is one component. Only parts that hold a wanted component are followed.

Sums and products are taken in the tasks; the driver sees one matrix, as large
as the square of the dimension whatever the number of rows, and the components
are broadcast to whiten every row in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import extended, fresh, in_arrow

COMPONENTS = 8
#: A whole number for an entry c is floor(SCALE * c) + OFFSET (fixed values).
SCALE, OFFSET = 1024, 100_000
#: Entries from this size on are an error: their sums could pass 64 bits in a task.
MAX_ENTRY = 2.0**39
_EPS = np.finfo(float).eps
_EXACT = "decimal(38,0)"


# spectral divide and conquer


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps.

    A step uses a QR factorisation while the weights are large and a Cholesky
    factorisation after that.
    """
    n, eye = len(a), np.eye(len(a))
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = _EPS / n  # no singular value that matters is below
    for _ in range(20):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            half = np.linalg.cholesky(eye + wc * (x.T @ x))
            solved = np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
            new = wb / wc * x + (wa - wb / wc) * solved
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(_EPS) and 1 - low <= 10 * _EPS:
            break
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Points to split at: the median of the diagonal, the mean, then points about the mean."""
    mean = np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(len(a))) / np.sqrt(len(a))
    yield float(np.median(np.diag(a)))
    yield float(mean)
    for k in range(1, 30):
        yield float(mean + spread * (2 * ((k * 0.6180339887498949) % 1) - 1))


def _split(a: np.ndarray, tolerance: float) -> tuple[np.ndarray, int]:
    """An orthogonal basis, its first ``k`` columns those of the subspace of the larger eigenvalues."""
    n, best = len(a), None
    random = np.random.default_rng(n)
    for shift in _shifts(a):
        projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis = np.linalg.qr(projector @ random.standard_normal((n, k)))[0]
        basis = np.linalg.qr(projector @ basis, mode="complete")[0]
        left = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or left < best[0]:
            best = left, basis, k
        if left <= tolerance:
            break
    if best is None:  # all shifts on one side: the eigenvalues are equal but for rounding
        return np.eye(n), 1
    return best[1], best[2]


def spectral_components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    The largest entry of an eigenvector is positive, so reruns agree.
    """
    norm = float(np.linalg.norm(a))
    values, vectors = [], []

    def follow(part: np.ndarray, basis: np.ndarray) -> None:
        n = len(part)
        if len(values) >= wanted:
            return
        mean = np.trace(part) / n
        if n == 1 or np.linalg.norm(part - mean * np.eye(n)) <= n * _EPS * norm:
            values.extend([float(mean)] * n)
            vectors.extend(basis.T)
            return
        own, k = _split(part, 8 * n * _EPS * norm)
        turned = own.T @ part @ own
        follow((turned[:k, :k] + turned[:k, :k].T) / 2, basis @ own[:, :k])
        follow((turned[k:, k:] + turned[k:, k:].T) / 2, basis @ own[:, k:])

    if len(a):
        follow(a, np.eye(len(a)))
    vectors = np.array(vectors).reshape(len(values), len(a))
    e = np.array([v @ a @ v for v in vectors])
    order = np.argsort(-e, kind="stable")[:wanted]
    e, vectors = e[order], vectors[order]
    signs = np.array([np.sign(v[np.argmax(np.abs(v))]) for v in vectors])
    return e, (vectors * signs.reshape(-1, 1)).T


# rows


def _finite(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors, -1 for those that are null or hold a null or non-finite entry, and all entries, end to end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.zeros(len(column), bool)
    bad[np.repeat(np.arange(len(column)), lengths)[~np.isfinite(entries)]] = True
    bad |= column.is_null().to_numpy(zero_copy_only=False)
    return np.where(bad, -1, lengths), entries[~np.repeat(bad, lengths)]


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    if len(entries) and np.abs(entries).max() >= MAX_ENTRY:
        raise ValueError(f"an entry of {MAX_ENTRY:g} or more in size")
    return np.floor(SCALE * entries).astype(np.int64) + OFFSET


def _of_dimension(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this dimension and their whole numbers, one row each."""
    lengths, entries = _finite(column)
    fits = lengths == dimension
    own = np.repeat(fits[lengths >= 0], lengths[lengths >= 0])
    return np.flatnonzero(fits), whole_numbers(entries[own]).reshape(-1, dimension)


def _decimals(numbers) -> pa.Array:
    """Whole numbers of any size that 38 digits hold."""
    return pa.array([Decimal(int(v)) for v in numbers], pa.decimal128(38, 0))


def _sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """The commonest dimension of the vectors that count (of equals, the larger), their number and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            lengths, entries = _finite(batch.column(0))
            lengths = lengths[lengths >= 0]
            for d in np.unique(lengths[lengths > 0]).tolist():
                x = whole_numbers(entries[np.repeat(lengths == d, lengths)]).reshape(-1, d)
                own = found.setdefault(d, [0, np.zeros(d, object)])
                own[0] += len(x)
                own[1] = own[1] + x.sum(axis=0)
        for d, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), _decimals(sums)], ["d", "at", "n", "total"])

    rows = in_arrow(vectors, run, f"d int, at int, n long, total {_EXACT}").groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    rows = [tuple(r) for r in rows.collect()]  # a row for each dimension
    if not rows:
        return 0, 0, []
    n, d = max((r[2], r[0]) for r in rows)
    return d, n, [int(r[3]) for r in sorted(rows) if r[0] == d]


def _products(y: np.ndarray) -> np.ndarray:
    """The exact sums of products of whole numbers, by rows that doubles add exactly."""
    peak = int(np.abs(y).max(initial=1))
    rows = 2**53 // (peak * peak)
    if not rows:
        z = y.astype(object)
        return z.T @ z
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(float)
        out = out + (part.T @ part).astype(np.int64)
    return out


def _covariance(vectors: DataFrame, dimension: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance with divisor n, every entry rounded once.

    Rows are centred at the means rounded to whole numbers; what that leaves is
    taken off the exact sums.
    """
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension), object)
        for batch in batches:
            total = total + _products(_of_dimension(batch.column(0), dimension)[1] - centre)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), _decimals(total[upper])], ["i", "j", "total"])

    rows = in_arrow(vectors, run, f"i int, j int, total {_EXACT}").groupBy("i", "j").agg(F.sum("total").alias("total"))
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    out = np.zeros((dimension, dimension))
    for i, j, total in rows.collect():  # the square of the dimension
        out[i, j] = out[j, i] = (n * int(total) - rest[i] * rest[j]) / (n * n)
    return out


@dataclass
class Model:
    """What the fit list gave: n, the sums, and the components as columns with their eigenvalues.

    ``trace`` is that of the covariance. Components without variance, but for
    rounding, are left out.
    """

    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n times each whole number less its sum, exact; of a type that holds the sum of their squares."""
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if top * top * max(1, len(self.sums)) < 2**63:
            return self.n * x - np.array(self.sums, np.int64)
        if top < 2**63:
            y = self.n * x - np.array(self.sums, np.int64)
            peak = int(np.abs(y).max(initial=0))
            return y if peak * peak * max(1, len(self.sums)) < 2**63 else y.astype(object)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(float) / self.n) @ (self.vectors / np.sqrt(self.values))


def fit(vectors: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS) -> Model:
    """The ``components`` of most variance of all vectors that count; see ``whiten`` for these."""
    rows = vectors.select(F.col(vector))
    dimension, n, sums = _sums(rows)
    if not n:
        return Model()
    covariance = _covariance(rows, dimension, n, sums)
    e, v = spectral_components(covariance, min(components, dimension))
    real = e > 10 * dimension * _EPS * max(float(np.trace(covariance)), 0.0)
    return Model(n, sums, e[real], v[:, real], float(np.trace(covariance)))


def whiten(vectors: DataFrame, model: Model, *, vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``whitened`` (a double for each component) and ``deviation`` (38 digits).

    ``deviation`` is the sum over the dimensions of (n * x - sum)**2, exact. A
    vector counts if it is not null, holds no null and no non-finite entry and
    has the dimension that most such vectors have (of equals, the larger); other
    rows are dropped. A null in another column is carried along, repeated rows
    count as they stand, an empty table or one without a vector that counts
    gives no rows. Directions without variance give no component, so vectors
    that are all the same have an empty ``whitened``. Other columns stay; one
    named like a result column is replaced by it.
    """
    vectors = fresh(vectors, "whitened", "deviation", needs=(vector,))
    schema = extended(vectors, f"whitened array<double>, deviation {_EXACT}")
    sent = vectors.sparkSession.sparkContext.broadcast(model)  # components times dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        k = len(own.values)
        for batch in batches if own.n else ():
            at, x = _of_dimension(batch.column(batch.schema.get_field_index(vector)), len(own.sums))
            y = own.deviations(x)
            white = own.whitened(y)
            squares = (y * y).sum(axis=1)
            total = pa.array(squares.astype(np.int64)).cast(pa.decimal128(38, 0)) if y.dtype != object else _decimals(squares)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(white.ravel()))
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, lists, total], [*batch.schema.names, "whitened", "deviation"])

    return in_arrow(vectors, run, schema)


def identity_error(vectors: DataFrame, model: Model, *, vector: str = "embedding") -> float:
    """The largest entry of the covariance of the whitened rows minus the identity, measured over all of them."""
    k = len(model.values)
    if not k:
        return 0.0
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for batch in batches:
            own = sent.value
            white = own.whitened(own.deviations(_of_dimension(batch.column(0), len(own.sums))[1]))
            total[:, :k] += white.T @ white
            total[:, k] += white.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "total"])

    sums = np.zeros((k, k + 1))
    for i, j, total in in_arrow(vectors.select(F.col(vector)), run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total")).collect():
        sums[i, j] = total
    mean = sums[:, k] / model.n
    return float(np.abs(sums[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())
