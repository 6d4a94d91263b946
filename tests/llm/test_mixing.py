from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from peneira.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Plain resharing: cap whoever is above, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


def test_targets_and_words(edges, edge_rows):
    rows = mixing.mix(edges).collect()
    assert len(rows) == len(edge_rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in edge_rows:
        sizes[source] += len((text or "").encode().split())
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= mixing.BLOCK_WORDS + 0.02 * target


@pytest.mark.parametrize(("sources", "shards"), [(40, 2), (4, 13)])
def test_many_sources_and_shards_stay_near(spark, sources, shards):
    name = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % sources).cast("string")))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 90 + 1).cast("int")).alias("text"), name.alias("source"))
    rows = mixing.mix(df, shard_words=4096)
    per = rows.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.count_distinct("shard").alias("n")).collect()
    assert max(r.n for r in per) >= shards
    for r in per:
        assert abs(r.k - r.t) <= 0.02 * r.t + 2 * mixing.BLOCK_WORDS * r.n**0.5
    again = mixing.mix(df.repartition(7), shard_words=4096)
    key = lambda d: sorted((r.doc_id, r.taken) for r in d.collect())
    assert key(rows) == key(again)


def test_quotas_are_highest_quotients(spark):
    aims = {("a", "x"): 1000, ("a", "y"): 333, ("a", "z"): 50, ("b", "x"): 77, ("b", None): 10}
    cells = spark.createDataFrame([(s, n, 10_000, a * mixing.MICRO) for (s, n), a in aims.items()], "shard string, source string, words long, aim long")
    got = {(r.shard, r.source): r.quota for r in mixing.quotas(cells, 16, 2).collect()}
    for shard in "ab":
        mine = {n: a for (s, n), a in aims.items() if s == shard}
        seats, won = round(sum(mine.values()) / 16), dict.fromkeys(mine, 0)
        for _ in range(seats):
            best = max(mine, key=lambda n: (mine[n] / (2 * won[n] + 1), n is not None))
            won[best] += 1
        assert {n: got[shard, n] for n in mine} == won


def test_copies_and_empty(edges, empty):
    rows = mixing.whole_copies(mixing.mix(edges)).collect()
    assert all(0 <= r.copies <= 3 and (r.size or not r.copies) for r in rows)
    assert mixing.mix(empty).count() == 0


def test_spans_are_what_is_taken(edges):
    rows = mixing.mix(edges).collect()
    assert any(r.spans for r in rows)
    for r in rows:
        assert r.taken == sum(x.last - x.first for x in r.spans) and all(0 <= x.first < x.last <= r.size and x.last - x.first <= mixing.BLOCK_WORDS for x in r.spans)


def test_equal_rows_are_spread(spark):
    hot = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("w " * 40).alias("text"), F.lit("a").alias("source"))
    own = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("v "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.concat(F.lit("b"), (F.col("id") % 2).cast("string")).alias("source"))
    df = hot.unionByName(own)
    rows = mixing.mix(df.repartition(6), shard_words=8192)
    per = rows.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.count_distinct("shard").alias("n")).collect()
    assert all(r.n >= 10 and abs(r.k - r.t) <= 0.02 * r.t + 2 * mixing.BLOCK_WORDS * r.n**0.5 for r in per)
    key = lambda d: sorted(((r.doc_id, r.taken) for r in d.collect()), key=str)
    assert rows.count() == 6000 and key(rows) == key(mixing.mix(df.repartition(3), shard_words=8192))
