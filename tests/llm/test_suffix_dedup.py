import hashlib
import random

from peneira.llm import queries
from peneira.llm import suffix_dedup as S


def brute(rows, span=100):
    """Scan of every window in order of ids."""
    seen, out = set(), {}
    for i, raw in sorted(rows):
        gone = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            w = raw[p : p + span]
            if w in seen:
                gone[p : p + span] = b"\1" * span
            seen.add(w)
        kept = bytes(x for x, m in zip(raw, gone, strict=True) if not m)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, texts, partitions=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    got = {r.doc_id: tuple(r)[1:] for r in S.digests(df).collect()}
    assert got == brute([(i, (t or "").encode()) for i, t in enumerate(texts)])


def test_edges(spark, edge_rows):
    check(spark, [r[1] for r in edge_rows if r[0] is not None][:-2])


def test_periodic_and_crossing(spark):
    rng = random.Random(5)
    unit = "".join(rng.choice("abc") for _ in range(37))
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 260))) for _ in range(8)]
    texts = [unit * 12, "x" + unit * 9, "b" * 99, "b" * 100, "b" * 101, "".join(parts), parts[3] + parts[2] + parts[4], parts[5][10:] + "éé" + parts[1] * 2]
    texts += ["".join(rng.choice(parts) for _ in range(5)) for _ in range(40)]
    check(spark, texts, 5)


def test_many_copies_over_many_partitions(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    check(spark, [text[: 850 + i % 5] + str(i) for i in range(60)] + [text] * 60, 12)


def test_repeated_rows_null_ids_and_columns(spark, edges, empty):
    rows = S.digests(edges).collect()
    assert len(rows) == edges.count()
    same = [tuple(r) for r in rows if r.doc_id == 4]
    assert len(same) == 3 and len(set(same)) == 1
    assert [r.n_removed for r in rows if r.doc_id is None] != []
    kept = S.without_repeats(edges, ["doc_id", "source", "tag"])
    assert kept.columns == ["doc_id", "source", "tag", "kept_text"] and kept.count() == len(rows)
    assert S.digests(empty).count() == 0


def test_long_texts_and_pieces(spark):
    rng = random.Random(7)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long_one = line(2 * S.CHUNK + 977)
    check(spark, [long_one, "x" + long_one[S.CHUNK - 300 : S.CHUNK + 300], long_one[5:-9], "y" * (S.CHUNK + 120), line(S.CHUNK) + long_one[: S.CHUNK // 2]], 2)


def test_hot_suffix_in_many_contexts(spark):
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for size in (85, 99):
        passage = line(size)
        own = [line(rng.randint(0, 150)) + passage + line(rng.randint(0, 150)) for _ in range(3 * S.HOT)]
        # the few of the last partitions are not hot there
        check(spark, own + ["more " + x[3:-3] for x in own[:40]], 1)
        df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartitionByRange(8, "doc_id")
        got = {r.doc_id: tuple(r)[1:] for r in S.digests(df.unionByName(df.where("doc_id < 150").coalesce(1).selectExpr("doc_id + 1000 as doc_id", "concat('z', text) as text"))).collect()}
        assert got == brute([(i, t.encode()) for i, t in enumerate(own)] + [(i + 1000, b"z" + t.encode()) for i, t in enumerate(own[:150])])


def test_equal_and_missing_ids(spark):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    repeated, unique = line(200), line(300)
    for other in (None, 5):
        rows = [(1, repeated + "z"), (other, repeated), (other, unique), (other, unique)]
        got = {(r.doc_id, r.n_bytes, r.n_removed) for r in S.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {(1, 201, 0), (other, 200, 200), (other, 300, 0)}
    passage = line(150)
    texts = [line(rng.randint(100, 200)) for _ in range(2300)]
    rows = [(0, passage)] + [(None, t + passage if i % 50 == 0 else t) for i, t in enumerate(texts)]
    got = S.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.n_bytes for r in got) == sorted(len(t) for _, t in rows)
    # some letters before the passage may be equal too
    cut = [r.n_removed for r in got if r.n_removed]
    assert len(cut) == 46 and all(150 <= n < 160 for n in cut)


def test_versions_of_an_id_in_order(spark):
    """Of two texts of one id that share a passage one keeps it."""
    rng = random.Random(10)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(180))
    rows = [(3, "one " + shared), (3, shared + " two"), (2, "none of it"), (9223372036854775807, shared), (None, shared)]
    got = S.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 180, 180, 180]
    assert {r.n_removed for r in got if r.doc_id is None or r.doc_id > 3} == {180}


def test_family_merges_equal_levels():
    import numpy as np

    family, rng = S.IndexFamily(), np.random.default_rng(1)
    late = 0
    for n in range(11):
        key = rng.integers(0, 40, 30).astype(np.int64)
        late += sum(len(d) for d, _ in family.add(key, key, key, np.zeros(30, np.int64), np.full(30, n), np.arange(30)))
    assert [size for size, _ in family.levels] == [8, 2, 1]
    assert late == 11 * 30 - sum(len(level.key) for _, level in family.levels)


def test_whole_table(spark):
    """Every document of a given table, as the query has them."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_suffix_dedup(spark, sf).collect()}
    assert len(got) == len(rows) and got == brute([(r.doc_id, (r.text or "").encode()) for r in rows])


def test_levels_meet_and_merge_on_a_table(spark, monkeypatch):
    """On the given documents a slice has many batches, whose levels merge geometrically; and the result is that of all windows."""
    import os

    import pyarrow as pa

    table = os.environ.get("TEST_LEVELS_DIR", "/root/testdata/sf0.01")
    rows = spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "text").toArrow().combine_chunks().to_batches()
    entries = [b for b in S._sample(S.SPAN)(iter(rows))]
    families = []

    class Watched(S.IndexFamily):
        def __init__(self):
            super().__init__()
            self.sizes, self.scans = [], 0
            families.append(self)

        def add(self, *batch):
            self.scans += len(self.levels)
            yield from super().add(*batch)
            self.sizes.append([n for n, _ in self.levels])

    monkeypatch.setattr(S, "IndexFamily", Watched)
    whole = pa.Table.from_batches(entries).combine_chunks().to_batches()
    flags = sum(b.num_rows for b in S._index(0)(iter(whole)))
    sizes = families[-1].sizes
    assert flags and len(sizes) >= 8 and max(len(x) for x in sizes) >= 3 and max(x[0] for x in sizes) >= 8 and families[-1].scans >= 8
    assert all(x == sorted(x, reverse=True) and len(set(x)) == len(x) for x in sizes)
