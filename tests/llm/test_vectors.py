"""Clustering and whitening against brute force."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from peneira.llm import clustering, queries, whitening

SCHEMA = "vec_id long, embedding array<double>, label int"
TABLE = "/root/testdata/sf0.001"


def vectors(n, dims=64, seed=3, groups=6):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(groups, dims))
    return [(i, (heads[i % groups] + rng.normal(size=dims) * 0.4).round(3).tolist(), i % groups) for i in range(n)]


def odd_rows(dims=64):
    rows = vectors(150)
    rows += [(900, None, 1), (901, [0.5] * (dims - 1) + [None], 1), (902, [math.nan] + [0.1] * (dims - 1), 1), (903, [math.inf] * dims, 1), (None, rows[3][1], 1), rows[5], rows[5], (910, rows[5][1], 2)]
    return rows


# ---- clustering


def lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in starts]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    give = lambda: [min(range(len(centres)), key=lambda j: (far(v, centres[j]), j)) for _, v in kept]
    for _ in range(rounds):
        at = give()
        for j in range(len(centres)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, j, far(v, centres[j])) for (i, v), j in zip(kept, give(), strict=True)]
    inertia = {j: sum(d for _, a, d in out if a == j) for j in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    top = clustering.LONGEST
    return sorted(((i, j, min(d, top), min(inertia[j], top), min(sum(inertia.values()), top), sha[j]) for i, j, d in out), key=str)


def clustered(df, **options):
    dims = options.get("dims", 64)
    return sorted(map(tuple, clustering.clustered(clustering.quantised(df, dims=dims), **options).collect()), key=str)


@pytest.mark.parametrize("k", [1, 7, 40])
def test_clusters_equal_plain_rounds(spark, k):
    rows = odd_rows() + [(950, [0.1] * 63, 1), (951, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"cluster": F.lit("x"), "w": F.lit(1), "n": F.lit(2), "upper": F.lit(3)})
    assert clustered(df, k=k) == lloyd(rows, k, 5, 64)


def test_ties_and_small_grids(spark):
    rows = [(i, [float(i % 3), float(i // 3 % 3)], 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert clustered(df, k=6, dims=2) == lloyd(rows, 6, 5, 2)
    same = [(i, [0.25, 0.5], 0) for i in range(9)]
    assert clustered(spark.createDataFrame(same, SCHEMA), k=4, dims=2) == lloyd(same, 4, 5, 2)


@pytest.mark.parametrize("scale", [1e5, 1e9, 1e30, 1e200])
def test_large_numbers_stay_exact(spark, scale):
    rows = [(i, [c * scale for c in v[:4]], 0) for i, v, _ in vectors(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert clustered(df, k=5, dims=4) == lloyd(rows, 5, 5, 4)


def test_bounds_spare_scans_and_no_vectors(spark):
    df = spark.createDataFrame(vectors(600), SCHEMA)
    measured, centroids = clustering.cluster(clustering.quantised(df), k=6)
    scans = measured.agg(F.sum("scans"), F.max("scans")).first()
    assert 600 <= scans[0] < 6 * 600 * 0.6 and centroids.agg(F.sum("size")).first()[0] == 600
    assert clustering.clustered(clustering.quantised(df.where("false"))).collect() == []
    assert clustered(spark.createDataFrame([(None, [0.5] * 64, 0)], SCHEMA)) == []


def test_query_equals_its_sql(spark):
    got = sorted(map(tuple, queries.op11_centroid_clustering(spark, TABLE).collect()))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{TABLE}/embeddings.parquet'")
    assert got == sorted(con.sql(clustering.SQL).fetchall())


# ---- whitening


def brute(rows, components=32):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), max(len(v) for _, v in kept)
    kept = [(i, v + [1_000_000] * (d - len(v))) for i, v in kept]
    sums = [sum(x) for x in zip(*(v for _, v in kept), strict=True)]
    centred = [[n * c - s for c, s in zip(v, sums, strict=True)] for _, v in kept]
    z = np.array([[float(c) for c in row] for row in centred]) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return kept, n, [sum(c * c for c in row) for row in centred], z @ u / np.sqrt(np.maximum(e, 1e-30)), e, float((z * z).sum() / n)


def check(df, rows, components=32):
    kept, n, deviation, w, e, trace = brute(rows, components)
    rank = int((e > 1e-12 * e[0]).sum())
    got = whitening.whitened(whitening.quantised(df), components).orderBy("vec_id", "component").collect()
    assert len(got) == len(kept) * rank and {r.n for r in got} == {n}
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is not None, kept[i][0] or 0))
    ids = [kept[i][0] for i in order]
    assert [r.vec_id for r in got] == [x for x in ids for _ in range(rank)] or sorted((r.vec_id is not None, r.vec_id or 0) for r in got) == sorted((x is not None, x or 0) for x in ids for _ in range(rank))
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for c, some in by.items():
        mine, want = np.array([r.whitened for r in some]), w[order, c - 1]
        gap = min(abs(e[c - 1] - e[j]) for j in range(len(e)) if j != c - 1) if len(e) > 1 else e[0]
        if gap > 1e-6 * e[0]:
            assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert [r.deviation for r in some] == [deviation[i] for i in order]
        assert abs(some[0].explained - e[c - 1] / trace) < 1e-9 and some[0].identity_error < 1e-8
    return got


def test_whitening_equals_a_plain_decomposition(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"x": F.lit("x"), "component": F.lit(1), "v": F.lit(2), "y": F.lit(3), "i": F.lit(4)})
    check(df, rows)
    short = vectors(40, 6) + [(100, [1.5, 2.5], 0), (101, [], 0)]
    check(spark.createDataFrame(short, SCHEMA), short)


def test_few_dimensions_and_low_rank(spark):
    rows = vectors(50, 3)
    check(spark.createDataFrame(rows, SCHEMA), rows)
    flat = [(i, [float(i), 2.0 * i, 5.0, -1.0 * i], 0) for i in range(30)]
    assert len(check(spark.createDataFrame(flat, SCHEMA), flat)) == 30
    df = spark.createDataFrame([(1, [0.5, 0.25], 0)] * 3, SCHEMA)
    assert whitening.whitened(whitening.quantised(df)).collect() == []
    assert whitening.whitened(whitening.quantised(df.where("false"))).collect() == []


def test_large_entries(spark):
    rows = [(i, [c * 1e12 for c in v[:5]], 0) for i, v, _ in vectors(40)]
    kept, n, deviation, w, e, trace = brute(rows)
    got = whitening.whitened(whitening.quantised(spark.createDataFrame(rows, SCHEMA))).where("component = 1").orderBy("vec_id").collect()
    assert [r.deviation for r in got] == [min(x, whitening.LONGEST) for x in deviation]
    mine, want = np.array([r.whitened for r in got]), w[:, 0]
    assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8


@pytest.mark.parametrize("kind", ["copies", "rank", "decay", "flat"])
def test_lanczos(kind):
    rng = np.random.default_rng(5)
    d = 120
    e = {"copies": np.r_[[9.0] * 30, [5.0] * 20, np.linspace(1, 2, 70)], "rank": np.r_[np.linspace(3, 9, 10), np.zeros(110)], "decay": 0.7 ** np.arange(d), "flat": np.ones(d)}[kind]
    u = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = u * e @ u.T
    got, vectors_, passes = whitening.lanczos(lambda q: a @ q, d, 32, 8)
    assert np.abs(got - np.sort(e)[::-1][:32]).max() < 1e-11 * e.max()
    assert np.abs(vectors_.T @ vectors_ - np.eye(32)).max() < 1e-11
    assert np.linalg.norm(a @ vectors_ - vectors_ * got, axis=0).max() < 1e-11 * e.max()
    assert passes <= 15


def test_whitening_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLE}/embeddings.parquet").collect()]
    check(spark.read.parquet(f"{TABLE}/embeddings.parquet"), rows)
    got = queries.op13_embedding_whitening(spark, TABLE)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 500 * 32
