"""Centroid clustering in whole numbers with Hamerly's bounds.

Vectors become rows of integers ``floor(scale * x)``. The first centroids are the
vectors whose ids have the least hashes. Each round gives every vector to its nearest
centroid and replaces each centroid by the floor of its vectors' mean; then vectors
are given out once more.

A vector's row keeps two bounds from round to round: an upper one on the distance to
its own centroid, and a lower one on the distance to any other. Centroids that move
loosen both by their drift. While the upper bound stays under the lower one, or under
half the way from the own centroid to the next, the vector stays where it is without
a look at the others; else the upper bound is made exact, and only if that doesn't
decide, all centroids are scanned in whole numbers. Bounds are rounded outwards, and
they decide only where they are strictly apart, so ties are always settled by a scan.

A round is one pass over the vectors, whose rows are written to the shared folder
(lineage ends there), and one over what was written, from which each task sends its
sums by centroid: rows in proportion to tasks and centroids, not to vectors. The driver
holds the centroids, whose number and length are parameters. Sums and distances are
exact at any size: in doubles while all terms stay under 2**53, in Python's whole
numbers beyond.

Defined results: vectors that are null, of another length, or with a null or
non-finite component (or one that scaling makes infinite) take no part; rows without
an id take part, but never start a centroid; repeated rows are vectors each, and of
equal hashes the lesser vector starts first; ties go to the smaller number; with fewer
vectors than centroids there are as many centroids as vectors with ids; without any,
no rows. A distance or inertia beyond a long counts as the largest long. Other columns
take no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import discard, exact_totals, limbs, materialize, whole_numbers

K, ROUNDS, SEED, DIMS, SCALE = 40, 5, 2, 64, 256
#: Bounds are rounded outwards by this share.
SLACK = 2.0**-50
LONGEST = (1 << 63) - 1
STATE = "vec_id long, w array<double>, cluster int, upper double, lower double, scans int"


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, w``: the integers of the vectors that take part, as doubles, which hold each of them exactly."""
    sound, w = whole_numbers(F.col("x"), scale)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x"))
    return rows.where((F.size("x") == dims) & sound).select("vec_id", w.alias("w"))


def _real(squares: np.ndarray) -> np.ndarray:
    """Roots of whole numbers of any size; infinite where a double can't hold the number."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    flat = [float(x) ** 0.5 if abs(x) < 1 << 1023 else np.inf for x in squares.ravel()]
    return np.array(flat, np.float64).reshape(squares.shape)


def _above(squares: np.ndarray) -> np.ndarray:
    return _real(squares) * (1 + SLACK)


def _below(squares: np.ndarray) -> np.ndarray:
    return np.minimum(_real(squares), sys.float_info.max) * (1 - SLACK)


def _objects(values: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape, object)
    out[...] = [[int(x) for x in row] for row in values]
    return out


class Centroids:
    """Centroids of one round, how far each moved since the last, and half the way to its nearest neighbour."""

    def __init__(self, rows: list[list[int]], before: Centroids | None = None):
        self.rows = rows
        self.most = max((abs(x) for r in rows for x in r), default=0)
        self.whole = np.empty((len(rows), len(rows[0]) if rows else 0), object)
        for i, r in enumerate(rows):
            self.whole[i] = r
        self.real = self.whole.astype(np.float64) if self.most < 1 << 53 else None
        drift = _above(((self.whole - before.whole) ** 2).sum(1)) if before else np.zeros(len(rows))
        self.drift = drift
        # the farthest that another centroid moved
        order = np.argsort(-drift, kind="stable")
        self.other_drift = np.full(len(rows), drift[order[0]] if len(rows) else 0.0)
        if len(rows):
            self.other_drift[order[0]] = drift[order[1]] if len(rows) > 1 else 0.0
        self.half = np.full(len(rows), np.inf)
        for i in range(len(rows)):
            rest = np.delete(self.whole, i, 0)
            if len(rest):
                self.half[i] = _below(((rest - self.whole[i]) ** 2).sum(1)).min() / 2

    def _fits(self, points: np.ndarray) -> bool:
        """Whether all terms of squared distances stay whole in doubles."""
        most = max(float(self.most), float(np.abs(points).max(initial=0)))
        return self.real is not None and 4.0 * max(1, points.shape[1]) * most * most < 2.0**53

    def own(self, points: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Squared distances to the given centroids."""
        if self._fits(points):
            return ((points - self.real[cluster]) ** 2).sum(1)
        return ((_objects(points) - self.whole[cluster]) ** 2).sum(1) if len(points) else np.zeros(0)

    def scan(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid, the squared distance to it, and that to the second nearest."""
        if self._fits(points):
            square = (points * points).sum(1)[:, None] - 2 * (points @ self.real.T) + (self.real * self.real).sum(1)
        else:
            p = _objects(points)
            square = np.stack([((p - c) ** 2).sum(1) for c in self.whole], 1)
        first = square.argmin(1)
        at = np.arange(len(points))
        nearest = square[at, first]
        if square.shape[1] == 1:
            return first, nearest, np.full(len(points), np.inf)
        square = square.copy()
        square[at, first] = square.max(1) + 1
        return first, nearest, square[at, square.argmin(1)]


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _list(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))


def _assign(centroids: Centroids, first: bool):
    """Gives vectors to centroids; a new round's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = _matrix(batch.column(1))
            if first:
                cluster, upper = np.zeros(len(w), np.int64), np.full(len(w), np.inf)
                lower, scans = np.zeros(len(w)), np.zeros(len(w), np.int32)
            else:
                cluster, upper, lower, scans = (batch.column(i).to_numpy().copy() for i in range(2, 6))
                upper = (upper + centroids.drift[cluster]) * (1 + SLACK)
                lower = lower - centroids.other_drift[cluster] * (1 + SLACK)
                lower = lower - np.abs(lower) * SLACK
            apart = np.maximum(lower, centroids.half[cluster])
            open_ = np.flatnonzero(~(upper < apart))
            if not first and len(open_):
                upper[open_] = _above(centroids.own(w[open_], cluster[open_]))
                open_ = open_[~(upper[open_] < apart[open_])]
            if len(open_):
                nearest, square, second = centroids.scan(w[open_])
                cluster[open_], upper[open_], lower[open_] = nearest, _above(square), _below(second)
                scans[open_] += 1
            columns = [batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scans)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "w", "cluster", "upper", "lower", "scans"])

    return run


def _sums(k: int):
    """A task's sums by centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, w = batch.column(0).to_numpy(), _matrix(batch.column(1))
            if total is None:
                total = np.zeros((k, w.shape[1]), object)
            count += np.bincount(cluster, minlength=k)
            if float(np.abs(w).max()) * len(w) < 2.0**53:
                belongs = np.zeros((k, len(w)))
                belongs[cluster, np.arange(len(w))] = 1
                total += _objects(belongs @ w)
            else:
                for c in np.unique(cluster):
                    total[c] += _objects(w[cluster == c]).sum(0)
        for c in np.flatnonzero(count):
            for i, part in enumerate(limbs(total[c])):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(c)], pa.int32()), pa.array([i], pa.int32()), pa.array([int(count[c]) if i == 0 else 0], pa.int64()), _list(part[None, :])], names=["cluster", "limb", "n", "parts"]
                )

    return run


def _measured(centroids: Centroids):
    """Adds the exact squared distances to the own centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                square = centroids.own(_matrix(batch.column(2)), batch.column(1).to_numpy())
                if square.dtype == object:
                    square = np.array([min(int(x), LONGEST) for x in square], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(square.astype(np.int64)), batch.column(3)], names=["vec_id", "cluster", "distance", "scans"])

    return run


def _digest(row: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> tuple[DataFrame, DataFrame]:
    """From ``vec_id, w`` as ``quantised`` gives them two tables: ``vec_id, cluster, distance, scans`` for the vectors
    (scans: rounds in which the bounds did not decide), and ``cluster, centroid, size, cluster_inertia, inertia, centroid_sha256``."""
    spark = vectors.sparkSession
    rows = materialize(vectors, "vectors")
    named = rows.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    starts = [[int(x) for x in r.w] for r in named.orderBy("h", "w").limit(k).collect()]
    centroids = Centroids(starts)
    state = rows.withColumns({"cluster": F.lit(0), "upper": F.lit(0.0), "lower": F.lit(0.0), "scans": F.lit(0)})
    if not starts:
        state = state.where("false")
    written = rows
    for n in range(rounds + 1 if starts else 0):
        state = materialize(state.mapInArrow(_assign(centroids, n == 0), STATE), "assigned")
        discard(written)
        written = state
        if n == rounds:
            break
        parts = state.select("cluster", "w").mapInArrow(_sums(len(starts)), "cluster int, limb int, n long, parts array<long>")
        totals = exact_totals(parts, dims, "cluster")
        means = [[s // totals[c][0] for s in totals[c][1]] if c in totals else row for c, row in enumerate(centroids.rows)]
        centroids = Centroids(means, centroids)
    measured = materialize(state.select("vec_id", "cluster", "w", "scans").mapInArrow(_measured(centroids), "vec_id long, cluster int, distance long, scans int"), "clusters")
    discard(written)
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    found = {r.cluster: (r.n, r.s) for r in measured.groupBy("cluster").agg(F.count("*").alias("n"), whole.alias("s")).collect()}
    every = min(sum(int(s) for _, s in found.values()), LONGEST)
    table = [(c, row, found.get(c, (0, 0))[0], min(int(found.get(c, (0, 0))[1]), LONGEST), every, _digest(row)) for c, row in enumerate(centroids.rows)]
    table = [(c, [float(x) for x in row], *rest) for c, row, *rest in table]
    return measured, spark.createDataFrame(table, "cluster int, centroid array<double>, size long, cluster_inertia long, inertia long, centroid_sha256 string")


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """Per vector its cluster, squared distance, the inertias and its centroid's digest."""
    measured, centroids = cluster(vectors, **options)
    # one row for each centroid: its number is a parameter
    return measured.join(F.broadcast(centroids.drop("centroid", "size")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    near = "arg_min(c.j, ((v.n - 2 * list_dot_product(v.w, c.w) + c.n)::hugeint * 1000 + c.j))"
    parts = [
        "q as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as w from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "v as (select row_number() over () as r, vec_id, w, list_dot_product(w, w) as n from q)",
        f"c0 as (select (row_number() over (order by sha256('{seed}:' || vec_id), w))::int - 1 as j, w, n from v where vec_id is not null qualify j < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as materialized (select v.r, any_value(v.vec_id) as vec_id, any_value(v.w) as w, any_value(v.n) as n, {near} as j from v, c{i} c group by v.r)")
        if i < rounds:
            parts.append(f"e{i} as (select j, unnest(w)::hugeint as x, generate_subscripts(w, 1) as d from a{i})")
            parts.append(f"s{i} as (select j, d, sum(x) as s, count(*) as m from e{i} group by j, d)")
            parts.append(f"m{i} as (select j, list(((s - ((s % m) + m) % m) // m)::double order by d) as w from s{i} group by j)")
            parts.append(f"c{i + 1} as materialized (select j, w, list_dot_product(w, w) as n from (select c.j, coalesce(m.w, c.w) as w from c{i} c left join m{i} m on m.j = c.j))")
    last = rounds
    parts.append(f"o as (select a.vec_id, a.j, (a.n - 2 * list_dot_product(a.w, c.w) + c.n)::bigint as distance, sha256(array_to_string(list_transform(c.w, lambda x: x::bigint), ',')) as h from a{last} a join c{last} c on c.j = a.j)")
    return "with " + ",\n".join(parts) + "\nselect vec_id, j::int as cluster, distance, (sum(distance) over (partition by j))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, h as centroid_sha256 from o"


#: The same in DuckDB, all rounds written out.
SQL = _sql()
