"""Embedding whitening by a matrix-free block Lanczos method.

Entries become whole numbers ``floor(scale * c) + shift``. Their covariance V is never
formed: a pass over the vectors takes a block of directions Q, centres each vector
exactly (``n * x - S`` in whole numbers), multiplies, and sends from each task one
matrix as wide as Q, which Spark adds up by row. Between passes the driver

1. makes the new block orthogonal to all earlier ones, twice (full
   reorthogonalisation), and orthonormal by its singular vectors;
2. where directions die out (breakdown), restarts with random ones orthogonal to all
   there are;
3. solves the projected problem, and takes the residual ``|V u - e u|`` of each wanted
   pair from the products it has. When all are below ``TOLERANCE`` of the largest
   eigenvalue, a fresh random block must bring nothing above them before they count;
   a basis of the whole space ends the search too.

The driver holds two matrices of dimensions times basis; dimensions are bounded by
``MOST_DIMS`` and checked. Their trace comes from the exact deviations of the vectors,
so explained shares need no other eigenvalues. A last pass measures the covariance of
what is whitened.

Defined results: vectors that are null or hold a null or non-finite entry (or one that
scaling makes infinite) are dropped; shorter vectors count as if filled up with zero
entries; rows without an id and repeated rows are rows each; numbers beyond a long
count as the nearest long; a component whose eigenvalue is nought but for rounding
(under ``NOUGHT`` of the largest) can't be whitened and is left out, so one vector, or
equal ones, give no rows; no rows give none. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import exact_totals, limbs, materialize, whole_numbers

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Directions in a pass.
BLOCK = 16
TOLERANCE, NOUGHT = 1e-13, 1e-12
MOST_DIMS = 1 << 14
LONGEST = (1 << 63) - 1
#: Entries beyond which whole numbers are kept at the nearest that leaves room for the shift.
MOST_ENTRY = float(1 << 62)
KIND = "vec_id long, component int, n long, deviation long, whitened double"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: ``floor(scale * entry)`` as longs, without the shift, which no centred number depends on."""
    sound, w = whole_numbers(F.col("v"), scale)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(sound)
    held = F.transform(w, lambda c: F.greatest(F.least(c, F.lit(MOST_ENTRY)), F.lit(-MOST_ENTRY)).cast("long"))
    return rows.select("vec_id", held.alias("x"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of longs; short ones filled up with zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Centre:
    """Count and sums of the fit list."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.most = max((abs(s) for s in sums), default=0)
        self.whole = np.array(sums, np.int64) if self.most < 1 << 62 else None

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exactly."""
        if self.whole is not None and self.n * float(np.abs(x).max(initial=0)) + self.most < float(1 << 62):
            return self.n * x - self.whole
        out = np.empty(x.shape, object)
        out[...] = [[self.n * int(c) - s for c, s in zip(row, self.sums, strict=True)] for row in x]
        return out

    def deviations(self, numerators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of squared numerators: as longs, exactly, at most the largest long; and as doubles."""
        real = (numerators.astype(np.float64) ** 2).sum(1)
        out = np.full(len(real), LONGEST, np.int64)
        small = real < 2.0**63 * (1 - 1e-6)
        if numerators.dtype == object:
            out[small] = [sum(int(c) ** 2 for c in row) for row in numerators[small]]
        else:
            # squares of one sign: no part of a sum exceeds it
            out[small] = (numerators[small] ** 2).sum(1)
        near = ~small & (real < 2.0**63 * (1 + 1e-6))
        out[near] = [min(LONGEST, sum(int(c) ** 2 for c in row)) for row in numerators[near]]
        return out, real

    def centred(self, numerators: np.ndarray) -> np.ndarray:
        return numerators.astype(np.float64) / self.n


def _list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, object), 0
        for batch in batches:
            x, n = _matrix(batch.column(0), width), n + batch.num_rows
            if float(np.abs(x).max(initial=0)) * len(x) < float(1 << 62):
                total += x.sum(0).astype(object)
            else:
                total += np.array([sum(int(c) for c in column) for column in x.T], object)
        for i, part in enumerate(limbs(total)):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([i], pa.int32()), pa.array([n if i == 0 else 0], pa.int64()), _list(part[None, :])], names=["all", "limb", "n", "parts"])

    return run


def _added(width: int, rows: int, each: Callable[[np.ndarray], np.ndarray], read: Callable[[pa.RecordBatch], np.ndarray]):
    """A task's sum over its batches of matrices of ``rows`` rows, one row of it a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = each(read(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), _list(total)], names=["i", "y"])

    return run


def _total(x: DataFrame, centre: Centre, width: int, rows: int, columns: int, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of the matrices that ``each`` makes of numerators."""
    run = _added(width, rows, each, lambda batch: centre.numerators(_matrix(batch.column(0), width)))
    parts = x.select("x").mapInArrow(run, "i int, y array<double>")
    sums = F.array(*(F.sum(F.get("y", F.lit(j))) for j in range(columns)))
    out = np.zeros((rows, columns))
    for r in parts.groupBy("i").agg(sums.alias("y")).collect():
        out[r.i] = r.y
    return out


def _random(rng: np.random.Generator, basis: np.ndarray, count: int) -> np.ndarray:
    """Random orthonormal directions, orthogonal to the basis."""
    fresh = rng.standard_normal((len(basis), count))
    for _ in range(2):
        fresh = fresh - basis @ (basis.T @ fresh)
        fresh = np.linalg.qr(fresh)[0]
    return fresh


def lanczos(apply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest eigenvalues of a symmetric map, falling, their unit vectors as columns, and the products taken."""
    rng = np.random.default_rng(seed)
    basis = images = np.zeros((dims, 0))
    new, passes, confirmed = _random(rng, basis, min(block, dims)), 0, None
    while True:
        product = apply(new)
        passes += 1
        basis, images = np.hstack([basis, new]), np.hstack([images, product])
        projected = basis.T @ images
        e, s = np.linalg.eigh((projected + projected.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        k = min(wanted, len(e))
        residuals = np.linalg.norm(images @ s[:, :k] - basis @ s[:, :k] * e[:k], axis=0)
        room = dims - basis.shape[1]
        done = len(e) >= wanted and bool((residuals <= tolerance * max(abs(e[0]), abs(e[-1]))).all())
        if not room or done and confirmed is not None and np.allclose(confirmed, e[:k], rtol=0, atol=1e-12 * max(abs(e[0]), 1e-300)):
            return e[:k], basis @ s[:, :k], passes
        confirmed = e[:k].copy() if done else None
        count = min(block, room)
        rest = np.zeros((dims, 0))
        if not done:
            left = product
            for _ in range(2):
                left = left - basis @ (basis.T @ left)
            u, size, _ = np.linalg.svd(left, full_matrices=False)
            rest = u[:, size > 1e-10 * max(abs(e[0]), abs(e[-1]), 1e-300)][:, :count]
            for _ in range(2):
                rest = np.linalg.qr(rest - basis @ (basis.T @ rest))[0]
        # a breakdown leaves fewer directions than a block has: restart with random ones
        new = np.hstack([rest, _random(rng, np.hstack([basis, rest]), count - rest.shape[1])]) if rest.shape[1] < count else rest


def _whitened(centre: Centre, width: int, factors: np.ndarray):
    """Rows of all components of each vector."""
    k = factors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                some = batch.slice(low, 4096)
                numerators = centre.numerators(_matrix(some.column(1), width))
                deviation, n = centre.deviations(numerators)[0], some.num_rows
                at = pa.array(np.repeat(np.arange(n), k))
                columns = [some.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, centre.n)), pa.array(np.repeat(deviation, k)), pa.array((centre.centred(numerators) @ factors).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened"])

    return run


def fit(x: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> tuple[Centre, int, np.ndarray, np.ndarray, float]:
    """Of ``x``: the centre, the dimensions, the eigenvalues above nought, their unit vectors as columns, and the trace."""
    width = x.agg(F.max(F.size("x"))).first()[0] or 0
    if width > MOST_DIMS:
        raise ValueError(f"vectors of over {MOST_DIMS} entries")
    none = Centre(0, []), 0, np.zeros(0), np.zeros((0, 0)), 0.0
    if not width:
        return none
    totals = exact_totals(x.select("x").mapInArrow(_sums(width), "all int, limb int, n long, parts array<long>"), width, "all")
    centre = Centre(*totals[0])
    n = centre.n

    def apply(directions: np.ndarray) -> np.ndarray:
        def each(numerators: np.ndarray) -> np.ndarray:
            z = centre.centred(numerators)
            return z.T @ (z @ directions)

        return _total(x, centre, width, width, directions.shape[1], each) / n

    # deviations are sums of (n * x - S) ** 2
    spread = _total(x, centre, width, 1, 1, lambda numerators: np.array([[(centre.deviations(numerators)[1] / (float(n) * n)).sum()]]))
    trace = float(spread[0, 0]) / n
    if trace <= 0:
        return none
    e, vectors, _ = lanczos(apply, width, min(components, width), block)
    real = e > NOUGHT * e[0]
    return centre, width, e[real], vectors[:, real], trace


def whitened(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """From ``vec_id, x`` as ``quantised`` gives them: a row for each vector and component with vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    x = materialize(vectors, "vectors")
    centre, width, e, directions, trace = fit(x, components, block)
    if not len(e):
        return spark.createDataFrame([], KIND + ", explained double, identity_error double")
    k, factors = len(e), directions / np.sqrt(e)

    def second(numerators: np.ndarray) -> np.ndarray:
        w = centre.centred(numerators) @ factors
        return np.vstack([w.T @ w, w.sum(0)])

    moments = _total(x, centre, width, k + 1, k, second) / centre.n
    covariance = moments[:k] - np.outer(moments[k], moments[k])
    error = float(np.abs(covariance - np.eye(k)).max())
    shares = F.array(*(F.lit(float(v) / trace) for v in e))
    rows = x.mapInArrow(_whitened(centre, width, factors), KIND)
    return rows.withColumns({"explained": F.get(shares, F.col("component") - 1), "identity_error": F.lit(error)})
