"""Sharding, packing, search, URL rules, extraction and the classifier."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from peneira.llm import html_extract, packing, rule_ensemble, sharding, topk, url_rules

# ---- extendible sharding


def test_shards_fit_and_are_needed(edges, edge_rows):
    limit = 6000
    rows = sharding.shard(edges, limit=limit).collect()
    assert len(rows) == len(edge_rows)
    size, keys = defaultdict(int), defaultdict(set)
    for r in rows:
        size[r.shard, r.page] += r.bytes
        keys[r.shard].add(r.doc_id)
        assert r.oversized == (r.bytes > limit)
    assert all(n <= limit for (s, p), n in size.items() if not any(r.oversized for r in rows if (r.shard, r.page) == (s, p)))
    whole = defaultdict(int)
    for r in rows:
        whole[r.depth, r.prefix] += r.bytes
    for (d, p), n in whole.items():
        # a bucket's parent was too large to stay whole
        if d:
            assert sum(b for (e, q), b in whole.items() if e >= d and q >> (e - d + 1) == p >> 1) > limit


def test_one_hot_key_overflows(spark):
    df = spark.range(500).select(F.lit(7).alias("doc_id"), F.lit("x" * 100).alias("text"))
    rows = sharding.shard(df, limit=1000).groupBy("shard", "page").agg(F.sum("bytes").alias("b")).collect()
    assert len(rows) == 50 and {r.b for r in rows} == {1000}


def test_hot_key_of_mixed_sizes_fills_its_pages(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 400).cast("int")).alias("text")).repartition(6)
    rows = sharding.shard(df, limit=4000).groupBy("shard", "page").agg(F.sum("bytes").alias("b")).collect()
    total = sum(r.b for r in rows)
    assert max(r.b for r in rows) <= 4000 and total / len(rows) > 3200
    over = spark.range(20).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("x"), F.when(F.col("id") % 2 == 0, 150).otherwise(90)).alias("text"))
    rows = sharding.shard(over, limit=100).groupBy("shard", "page").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert len(rows) == 20 and {(r.b, r.n) for r in rows} == {(150, 1), (90, 1)}


def test_shards_are_written_with_their_rows(spark, edges, empty, tmp_path):
    rows = [(7, f"{i:04}" + "x" * (96 + i % 2)) for i in range(500)] + [(None, f"n{i:04}" + "y" * 95) for i in range(300)] + [(i, f"own text {i}") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = str(tmp_path / "shards")
    got = sharding.write_shards(docs, path, limit=1000).collect()
    assert sorted((tuple(r.document) for r in got), key=str) == sorted(rows, key=str)
    size, files = defaultdict(int), defaultdict(set)
    for r in got:
        assert r.doc_id == r.document.doc_id and r.bytes == len(r.document.text)
        size[r.shard, r.page] += r.bytes
    assert max(size.values()) <= 1000
    for r in spark.read.parquet(path).select("shard", "page", F.input_file_name().alias("file")).collect():
        files[r.shard, r.page].add(r.file)
    assert files.keys() == size.keys() and all(len(f) == 1 for f in files.values())
    # pages stand whole, one after the other, many to a file
    table = sharding.offsets(spark, path).collect()
    assert {(r.shard, r.page): r.bytes for r in table} == size and len({r.file for r in table}) < len(table)
    for file in {r.file for r in table}:
        spots = sorted((r.first, r.rows) for r in table if r.file == file)
        assert [a for a, _ in spots] == [sum(n for _, n in spots[:i]) for i in range(len(spots))]
    one = max(table, key=lambda r: r.rows)
    assert sorted(map(tuple, sharding.read_shard(spark, path, one.shard, one.page).collect()), key=str) == sorted((tuple(r.document) for r in got if (r.shard, r.page) == (one.shard, one.page)), key=str)
    mixed = sharding.write_shards(edges, limit=6000)
    assert mixed.count() == edges.count() and mixed.select("document.*").exceptAll(edges).count() == 0
    assert sharding.write_shards(empty).count() == 0


# ---- packing


def test_patterns_hold_all_items():
    rng = random.Random(1)
    for cap in (10, 30, 100):
        for _ in range(200):
            counts = [0] * (cap + 1)
            for _ in range(rng.randint(0, 60)):
                counts[rng.randint(1, cap)] += 1
            left = list(counts)
            patterns = packing.reduce_dominated(left, cap) + packing.best_fit(left, cap)
            got = [0] * (cap + 1)
            for pattern, n in patterns:
                assert sum(a * b for a, b in pattern) <= cap
                for a, b in pattern:
                    got[a] += b * n
            assert got == counts


def test_reduction_keeps_the_optimum():
    from functools import lru_cache

    rng = random.Random(2)

    def optimum(items, cap):
        items = tuple(sorted(items, reverse=True))

        @lru_cache(None)
        def go(rest):
            if not rest:
                return 0
            best = len(rest)

            def fill(room, left, chosen_any):
                nonlocal best
                moved = False
                for i, x in enumerate(left):
                    if x <= room and (i == 0 or left[i - 1] != x):
                        moved = True
                        fill(room - x, left[:i] + left[i + 1 :], True)
                if not moved:
                    best = min(best, 1 + go(left))

            fill(cap - rest[0], rest[1:], True)
            return best

        return go(items)

    sizes = set()
    for trial in range(160):
        cap, items = 20, [rng.randint(4 if trial % 2 else 2, 19 if trial % 3 else 9) for _ in range(rng.randint(1, 9))]
        counts = [0] * (cap + 1)
        for x in items:
            counts[x] += 1
        fixed = packing.reduce_dominated(counts, cap)
        rest = [x for x in range(cap + 1) for _ in range(counts[x])]
        sizes.update(sum(m for _, m in pattern) for pattern, _ in fixed)
        assert sum(n for _, n in fixed) + optimum(rest, cap) == optimum(items, cap)
    assert sizes == {1, 2, 3}


def test_best_fit_equals_plain_best_fit():
    """Bins of one filling are handled together; item by item the fillings are the same."""
    rng = random.Random(3)
    for _ in range(100):
        cap = rng.choice([12, 30, 64])
        items = sorted((rng.randint(1, cap) for _ in range(rng.randint(0, 80))), reverse=True)
        counts, plain = [0] * (cap + 1), []
        for x in items:
            counts[x] += 1
            fit = max((b for b in plain if b + x <= cap), default=None)
            if fit is None:
                plain.append(x)
            else:
                plain[plain.index(fit)] += x
        got = sorted(sum(a * b for a, b in pattern) for pattern, n in packing.best_fit(counts, cap) for _ in range(n))
        assert got == sorted(plain)


def test_pieces_and_places(edges, edge_rows):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = packing.pack(edges, path).collect()
    t, want = Tokenizer.from_file(path), []
    for i, text, *_ in edge_rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want.append((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_pieces_carry_their_ids(edges, edge_rows, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows, t = packing.pack(edges, path).collect(), Tokenizer.from_file(path)
    want = [(i, k // 2048, ids[k : k + 2048]) for i, text, *_ in edge_rows for ids in [t.encode(text or "", add_special_tokens=False).ids + [0]] for k in range(0, len(ids), 2048)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.ids)) for r in rows)
    assert all(len(r.ids) == r.length for r in rows) and packing.pack(empty, path).count() == 0


def test_odd_texts_tokenise_alike():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["it's I'M, dogs'. x.., y.", "<|endoftext|> x<|startoftext|>y <|STARTOFTEXT|>", "a\x1cb ÀÉ×÷ß İst ab-c, d--. ’. É.", "", "  ", 'A"b(c) end.', "***Wörter%%% e\u0301x. ª º µ.", "日本語。 текст, 12.5, 3.", "a" * 3000, "ΟΔΟΣ ΑΣ. ΑΣ- ΣΑΣ ΌΣΟΣ, aΣ", "K Å ẞ STRAẞE"]
    got = list(packing.ids_of([x.encode() for x in texts], path))
    assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


# ---- exact search


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16).round(1)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 16), (2003, [1.0, 2.0]), (None, rows[0][1]), (100, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    v = topk.quantised(df)
    got = defaultdict(list)
    for r in topk.top_k(v, v.where("vec_id % 100 = 0"), 10, chunk=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = [(i, [int(np.floor(x * 1024)) for x in e]) for i, e in rows if i is not None and e and not any(x is None or x != x for x in e)]
    for i, w in {k: w for k, w in q if k % 100 == 0}.items():
        every = sorted((-sum(a * b for a, b in zip(w, u)), j) for j, u in q if j != i)[:10]  # noqa: B905
        assert got[i] == [(j, -s) for s, j in every]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 2e4, 1e9, 1e13, 1e30])
def test_search_with_large_components(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * scale * (1 if i % 3 else 1e-3)]) for i in range(300)]
    rows += [(900 + i, rows[7][1]) for i in range(20)] + [(-4, [1e308] * 8)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")))
    got = defaultdict(list)
    for r in topk.top_k(v, v.where("vec_id % 100 = 0"), 11).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    from fractions import Fraction

    w = {i: [int(Fraction(x * 1024) // 1) for x in e] for i, e in rows if i >= 0}
    most = (1 << 63) - 1
    for i in [x for x in w if x % 100 == 0]:
        every = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(w[i], u, strict=True)))), j) for j, u in w.items() if j != i)[:11]
        assert got[i] == [(j, -s) for s, j in every]


# ---- URL rules


def test_verdicts(spark):
    urls = ["https://WWW.example.org/es/1?x#y", "http://a.example.org/en/12", "http://example.org/en/2", "http://notexample.org/", "https://b.com/fr/x", "https://b.com/de/", "http://b.com", "no scheme", None, "", "x://h://p/q", "HTTP://C.net/a?u://v/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: tuple(r)[1:] for r in url_rules.judge(pages, spark.createDataFrame([], "url string, bad boolean")).collect()}
    assert rows[0] == ("www.example.org", "/es/1", "example.org/es/", "block") and rows[1][2:] == ("example.org/en/1", "block")
    assert rows[2][2:] == ("org/", "allow") and rows[3][2:] == ("org/", "allow") and rows[4][2:] == ("com/fr/", "allow") and rows[5][2:] == ("com/de/", "block")
    assert rows[6] == ("b.com", "", None, "allow") and rows[7] == rows[8] == rows[9] == ("", "", None, "allow")
    assert rows[10][:2] == ("h:", "//p/q") and rows[11][:2] == ("c.net", "/a")


def test_mined_rules_equal_enumeration(spark):
    from itertools import combinations

    rng = random.Random(8)
    rows = []
    for i in range(600):
        name, part = rng.choice(["good", "spam", "news"]), rng.choice(["win", "read", "shop"])
        bad = rng.random() < (0.95 if (name, part) in {("spam", "win"), ("news", "shop")} else 0.1)
        rows.append((f"http://{name}.example.net/{part}/{i}", bad))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    items = [(frozenset(r.t), r.bad) for r in df.select(url_rules.tokens(F.col("url")).alias("t"), "bad").collect()]
    count, hits = defaultdict(int), defaultdict(int)
    for t, bad in items:
        for n in (1, 2, 3):
            for c in combinations(sorted(t), n):
                count[c] += 1
                hits[c] += bad
    conf = {c: hits[c] / count[c] for c in count if hits[c] >= 20 and hits[c] / count[c] >= 0.5}
    want = {c for c, p in conf.items() if not any(s in conf and conf[s] >= p for s in combinations(c, len(c) - 1))}
    mined = url_rules.mine(df)
    assert {tuple(r.tokens) for r in mined.collect()} == want and want
    urls = df.select("url", url_rules.tokens(F.col("url")).alias("own"))
    got = {r.url for r in url_rules.matched(urls, mined).where("hit").collect()}
    sent, url_rules.MOST_SENT = url_rules.MOST_SENT, 0
    try:
        assert got == {r.url for r in url_rules.matched(urls, mined).where("hit").collect()}
    finally:
        url_rules.MOST_SENT = sent
    assert got == {u for (u, _), (t, _) in zip(rows, items, strict=True) if any(set(c) <= t for c in want)}


def test_rules_by_lift_equal_enumeration(spark, sf_dir):
    """The registered query on generated pages: its rules decide, and are those that an enumeration finds."""
    from itertools import combinations
    from math import ceil, sqrt

    from peneira.llm import queries

    sf = sf_dir.replace("sf0.001", "sf0.01")
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()]
    bad = {u: zlib.crc32(u.encode()) % 13 != 0 if u.startswith(("https://m.", "https://blog.")) else zlib.crc32(u.encode()) % 11 == 0 for u in urls if u}
    own = {r.url: frozenset(r.t) for r in spark.createDataFrame([(u,) for u in bad], "url string").select("url", url_rules.tokens(F.col("url")).alias("t")).collect()}
    rows = [(own[u], bad[u]) for u in urls if u and own[u]]
    base, least = sum(b for _, b in rows) / len(rows), max(20, ceil(0.002 * len(rows) - 1e-9))
    # only sets whose parts all come with enough bad labels can
    level, conf = {()}, {}
    while level:
        count, hits = defaultdict(int), defaultdict(int)
        for t, b in rows:
            for c in combinations(sorted(t), len(next(iter(level))) + 1):
                if all(s in level for s in combinations(c, len(c) - 1)):
                    count[c] += 1
                    hits[c] += b
        level = {c for c in count if hits[c] >= least}
        conf |= {c: hits[c] / count[c] for c in level if hits[c] / count[c] >= 2 * base and (hits[c] / count[c] - base) * sqrt(count[c] / (base * (1 - base))) >= 4}
    want = {c for c, p in conf.items() if not any(s in conf and conf[s] >= p for s in combinations(c, len(c) - 1))}
    got = {r.page_id: r.verdict for r in queries.url_rules_mined(spark, sf).collect()}
    assert len(got) == len(urls) and want
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect():
        assert got[r.page_id] == ("block" if r.url and any(set(c) <= own[r.url] for c in want) else "allow")
    assert 0 < sum(v == "block" for v in got.values()) < len(got) / 2


def test_chance_makes_no_rules(spark):
    rng = random.Random(12)
    rows = [(f"http://{rng.choice('abcdefgh')}.net/{rng.choice('xyz')}/{rng.choice('klmn')}", rng.random() < 0.15) for _ in range(4000)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    assert url_rules.mine(df, **url_rules.BY_LIFT).count() == 0
    assert url_rules.mine(df.withColumn("bad", F.lit(False)), **url_rules.BY_LIFT).count() == 0


def test_url_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, rule int, host int, verdict int")
    labels = spark.createDataFrame([], "url string, bad boolean")
    assert url_rules.judge(none, labels).collect() == []
    one = spark.createDataFrame([(1, "http://a-b.c/" + "x" * 200_000, 5), (None, None, 6), (1, "http://a-b.c/", 7)], "page_id long, url string, anchor int")
    assert len(url_rules.judge(one, labels).collect()) == 3


def test_rules_of_any_length(spark):
    from itertools import combinations

    rng = random.Random(9)
    rows = []
    for i in range(3000):
        parts = [x for x in ("a", "b", "c", "d") if rng.random() < 0.4]
        rows.append((f"http://e.net/{'/'.join(parts)}?n={i}", len(parts) == 4))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    items = [(frozenset(r.t), r.bad) for r in df.select(url_rules.tokens(F.col("url")).alias("t"), "bad").collect()]
    count, hits = defaultdict(int), defaultdict(int)
    for t, bad in items:
        for n in range(1, len(t) + 1):
            for c in combinations(sorted(t), n):
                count[c] += 1
                hits[c] += bad
    conf = {c: hits[c] / count[c] for c in count if hits[c] >= 20 and hits[c] / count[c] >= 0.5}
    want = {c for c, p in conf.items() if not any(s in conf and conf[s] >= p for s in combinations(c, len(c) - 1))}
    assert {tuple(r.tokens) for r in url_rules.mine(df).collect()} == want == {("path=a", "path=b", "path=c", "path=d")}
    pages = df.select(F.monotonically_increasing_id().alias("page_id"), "url")
    blocked = url_rules.judge(pages, df, rules=()).where("verdict = 'block'").count()
    assert blocked == sum(bad for _, bad in rows) > 20


def test_parameter_values_are_tokens(spark):
    rows = [(f"http://e.net/x?kind={'ad' if i % 2 else 'news'}&n={i}&flag&void=", i % 2 == 1) for i in range(100)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    want = {"scheme=http", "host=e", "host=net", "path=x", "query=kind", "query=n", "query=flag", "query=void", "query=kind=ad", "query=n=#", "query=void="}
    assert set(df.where("bad").select(url_rules.tokens(F.col("url"))).first()[0]) == want
    assert ("query=kind=ad",) in {tuple(r.tokens) for r in url_rules.mine(df).collect()}


# ---- extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies, and this is the text of the notice for you.</div>
<main><h1>The  title &amp; more</h1><p>It was the best of the times and it was the worst of them, for all.<br>Next&nbsp;line</p><p><b>Short.<ul><li>one</li><li>two</li></ul>
<div class="comments"><p>I think that it is the best of all the articles that I have read on this.</p></div></main>
<aside><p>The most read of the week is here and it is for you to see now.</p></aside><form>Your name <input></form><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    want = "The title & more\n\nIt was the best of the times and it was the worst of them, for all. Next line\n\nShort.\n\none\n\ntwo"
    cases = [PAGE, None, "", "just plain words", "<p>unclosed <b>bold", "<div><a href=x>only a link in here</a></div>", "<script>never closed <p>x", "<p>1 < 2 &#233; &bogus; </p>" + " " * 10, "<" * 2000]
    df = spark.createDataFrame([(i, "u", c) for i, c in enumerate(cases)] * 2, "page_id long, url string, html string")
    rows = sorted(html_extract.extract(df).collect())
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 2 * len(cases) and all(r.n_chars == len(r.text) for r in rows)
    assert got[0] == want and got[1] == got[2] == "" and got[3] == "just plain words" and got[4] == "unclosed bold" and got[5] == "" and got[6] == ""
    assert got[7] == "1 < 2 é &bogus;"


def test_pages_without_article():
    page = "<div class=menu><a href=/>a</a></div><div><h2>News</h2><p>" + "This is the story of the town and of the people in it. " * 6 + "</p><p>He left.</p></div><div class='footer-links'>x y z</div>"
    assert html_extract.main_text(page).split("\n\n")[0] == "News" and html_extract.main_text(page).endswith("He left.")


# ---- classifier


def test_rules_learn_and_compile(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "house", "stood", "near", "water", "and", "quiet."]) for _ in range(rng.randint(5, 80)))
    junk = lambda: " ".join(rng.choice(["BUY", "NOW!!", "$$$", "win***", "#1"]) for _ in range(rng.randint(5, 80)))
    rows = [(i, junk() if i % 4 == 0 else good()) for i in range(600)] + [(9000, None), (9001, ""), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(600)] + [(9001, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in rule_ensemble.score(docs, labels).collect()}
    held = [i for i in range(600) if out[i].held_out]
    assert len(out) == 603 and held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].predicted == (i % 4 != 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    flat = rule_ensemble.score(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert len(flat) == 1 and flat[0].score > 0.99
    assert rule_ensemble.score(docs, labels.limit(0)).select("score").distinct().first()[0] == 0.5
    assert rule_ensemble.score(docs.limit(0), labels).count() == 0


def test_sample_is_of_least_hashes(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("y"), *(F.col("id").cast("double").alias(s) for s in rule_ensemble.STATISTICS))
    df = df.unionByName(df.where("doc_id < 700")).repartition(5)
    order = df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h")).collect()
    for n in (1, 100, 5000, 9000):
        want = [float(r.doc_id) for r in sorted(order, key=lambda r: (r.h, r.doc_id))[:n]]
        assert [r[1] for r in rule_ensemble.sampled(df, n)] == want


def test_split_is_the_best_one():
    """A tree of one split against a plain search over all thresholds."""
    rng = np.random.default_rng(2)
    for trial in range(20):
        x = rng.integers(0, 12, (200, 3)).astype(float)
        y = (x[:, trial % 3] + rng.normal(size=200) * 2 > 5).astype(float)
        rules = rule_ensemble.tree_rules(x, y, trees=1, depth=1)
        p = y.mean()
        best = max((sum((y[m] - p).sum() ** 2 / (m.sum() * p * (1 - p) + 1) for m in (x[:, f] > c, x[:, f] <= c)), -f, -c) for f in range(3) for c in range(11) if 0 < (x[:, f] > c).sum() < 200)
        assert {rule[0][0] for rule in rules} == {-best[1]} and {rule[0][1] for rule in rules} == {-best[2]} and len(rules) == 2


def test_lasso_meets_its_conditions():
    """At the optimum the gradient is the penalty against each weight, and no more where the weight is zero."""
    rng = np.random.default_rng(3)
    r = (rng.random((400, 12)) < 0.4).astype(np.float32)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 1.5 * r[:, 1] + 0.2)))).astype(float)
    for penalty in (0.003, 0.02, 0.5):
        w, b = rule_ensemble.lasso(r, y, penalty, 4000)
        spread = np.sqrt(r.mean(0) * (1 - r.mean(0)))
        gradient = ((r - r.mean(0)) / spread).T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / len(y)
        own = np.abs(w) > 1e-6
        assert np.allclose(gradient[own], -penalty * np.sign(w[own]), atol=2e-4) and (np.abs(gradient[~own]) <= penalty + 2e-4).all()
        assert own.any() == (penalty < 0.5)


def test_column_equals_plain_sum(spark):
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(400, len(rule_ensemble.STATISTICS))))
    y = (x[:, 2] + 0.3 * rng.normal(size=400) > 0.8).astype(float)
    e = rule_ensemble.fit(x, y)
    assert 0 < len(e.rules) < 400
    want = 1 / (1 + np.exp(-(e.intercept + sum(w * rule_ensemble.holds(r, x) for r, w in zip(e.rules, e.weights, strict=True)))))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(rule_ensemble.STATISTICS))
    assert np.allclose([r[0] for r in df.select(e.column()).collect()], want)
