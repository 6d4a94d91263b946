import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, edges, empty, edge_rows):
    from peneira.llm.common import materialize

    docs, seen = edges, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
        seen.append((name, docs))
        if name != "best_fit_packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = {r.doc_id: r for r in seen[1][1].collect()}
    # of copies and near copies the least id stays
    copies = [r[0] for r in edge_rows if r[1] == edge_rows[3][1]]
    assert len(copies) == 3 and [i for i in copies if i in kept] in ([copies[0]], [])
    assert seen[0][1].count() <= len(edge_rows) and None in {r.doc_id for r in seen[0][1].collect()}
    before, after = {r.doc_id: r.text for r in seen[1][1].collect()}, {r.doc_id: r.text for r in seen[2][1].collect()}
    assert before.keys() == after.keys() and sum(map(len, after.values())) < sum(map(len, before.values()))
    pieces = seen[4][1].collect()
    assert {(r.doc_id) for r in pieces} <= set(after)
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_stages_equal_plain_models(spark, edge_rows):
    """Each stage against a plain model of it, on its own input."""
    from collections import Counter, defaultdict

    import duckdb
    import numpy as np
    import public_tokenizers
    from test_suffix_dedup import brute
    from tokenizers import Tokenizer

    from peneira.llm import quality_rules
    from peneira.llm.common import materialize

    shared = "this line stands in many documents of one host, and so it goes"
    rows = [r for r in {r[0]: r for r in edge_rows if r[0] is not None}.values()]
    rows += [(500 + i, f"{shared}\n{t[1]}", "en", "s9", 0) for i, t in enumerate(rows[20:34])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tables = {0: rows}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        docs = materialize(stage(spark, docs, ""), name)
        tables[n] = [tuple(r) for r in docs.collect()]
    # quality rules: SQL says what stays; lines of over ten documents of a host go
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    stays = {r[0] for r in con.sql(f"select doc_id from ({quality_rules.SQL}) q where kept").fetchall()}
    normal = lambda x: "".join("0" if c in "0123456789" else " " if c in "\t\x0b\x0c\r" else c for c in x).strip(" ").lower()
    held = defaultdict(set)
    for _, text, _, source, _ in rows:
        for x in (text or "").split("\n"):
            if x.strip(" \t\x0b\x0c\r"):
                held[source, normal(x)].add(text)
    frequent = {k for k, v in held.items() if len(v) > 10}
    want = {}
    for i, text, _, source, _ in rows:
        if i in stays:
            want[i] = "\n".join(x for x in text.split("\n") if (source, normal(x)) not in frequent)
    assert {r[0]: r[1] for r in tables[1]} == want and any(shared in (r[1] or "") for r in rows) and not any(shared in t for t in want.values())
    # near duplicates: the least id of each group by whole sets of five words
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, lead = {i: grams(t) for i, t in want.items()}, {i: i for i in want}

    def root(i):
        return i if lead[i] == i else root(lead[i])

    for i in want:
        for j in want:
            if i < j and (want[i] == want[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                lead[b] = a
    assert {r[0]: r[1] for r in tables[2]} == {i: want[i] for i in want if root(i) == i}
    # repeated strings
    before = {r[0]: r[1].encode() for r in tables[2]}
    lengths = brute(list(before.items()))
    for i, text, *_ in tables[3]:
        size, gone, *_ = lengths[i]
        assert size - gone - 3 * lengths[i][2] * 2 <= len(text.encode()) <= size - gone
    # whole copies, near the targets
    words, copies = {r[0]: len(r[1].encode().split()) for r in tables[3]}, Counter(r[0] for r in tables[4])
    assert {r[:4] for r in tables[4]} <= {r[:4] for r in tables[3]} and max(copies.values()) <= 3
    total = sum(words.values())
    assert 1.1 * total < sum(words[i] * n for i, n in copies.items()) < 1.9 * total
    # tokens round trip
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter()
    for r in docs.collect():
        ids[r.doc_id] += r.length
        assert len(r.ids) == r.length <= 2048
    tokens = {r[0]: len(t.encode(r[1], add_special_tokens=False).ids) + 1 for r in tables[4]}
    assert ids == {i: n * tokens[i] for i, n in copies.items()} and np.all([r.offset + r.length <= 2048 for r in docs.collect()])


def test_texts_that_share_an_id_stay(spark):
    """Near duplicates go, other texts of the same id, or of none, stay, whatever the order of rows."""
    words = [f"w{i}" for i in range(400)]
    a, b, c, d = (" ".join(words[i : i + 90]) for i in (0, 100, 200, 300))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a + " x", "en", "t", 1), (None, c, "en", "s", 1), (None, d, "en", None, 1), (None, c, "en", "s", 1), (3, b, "de", "s", 1), (5, c + " z", "en", "s", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    want = sorted([(1, a), (1, b), (5, c + " z"), (None, d)], key=str)
    for order in (rows, rows[::-1]):
        out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(order, kind).repartition(3), "")
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want and out.columns == list(corpus_pipeline.COLUMNS)


def test_run_leaves_its_result_only(spark, sf_dir):
    import os

    from peneira.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf_dir)
    assert {x.split("-")[0] + x.split("-")[1][:4] for x in set(os.listdir(folder)) - before} == {"stagebest"} and out.count() > 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
