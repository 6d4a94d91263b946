"""Spans, duplicates, files, access and streams, against small plain models."""

import random

import pytest
from pyspark.sql import functions as F

from peneira.operators import dedup, spans
from peneira.plans import access, feedback
from peneira.sources import files


def _spans(spark, rng, docs=12, each=9):
    rows = [(d, s + 1, a := rng.randint(0, 40), a + rng.randint(1, 9), round(rng.random(), 3), rng.choice(["regex", "bert_ner"])) for d in range(docs) for s in range(each)]
    return rows, spark.createDataFrame(rows, "doc_id long, seq int, s int, e int, score double, fonte string")


def test_islands(spark):
    rows, df = _spans(spark, random.Random(3))
    want = set()
    for d in {r[0] for r in rows}:
        groups = []
        for _, _, s, e, *_ in sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[1])):
            if groups and s < groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], e)
            else:
                groups.append([s, e])
        want |= {(d, s, e) for s, e in groups}
    assert {(r.doc_id, r.s, r.e) for r in spans.merge_overlaps(df).collect()} == want


def test_prefer_and_evaluate(spark):
    df = spark.createDataFrame([(1, 1, 0, 5, 0.9, "a"), (1, 2, 3, 12, 0.5, "b"), (1, 3, 20, 22, 0.1, "a")], "doc_id long, seq int, s int, e int, score double, fonte string")
    pick = lambda **k: sorted(r.seq for r in spans.prefer(df, **k).collect())
    assert pick() == [2, 3] and pick(by="score") == [1, 3] and pick(by="source", sources=["b"]) == [2, 3] and pick(by="custom", choose=lambda g: g[0]) == [1, 3]
    r = spans.evaluate(df.where("seq <> 2"), df.where("seq <> 3")).first()
    assert (r.tp, r.fp, r.fn, r.precision_spans, r.recall_spans) == (1, 1, 1, 0.5, 0.5)


def test_prefer_and_evaluate_against_plain_loops(spark):
    rng = random.Random(3)
    schema = "doc_id long, seq int, s int, e int, score double, fonte string"
    rows = [(d, i, s := rng.randint(0, 40), s + rng.choice([0, 1, 2, 5, 9]), rng.choice([None, 0.1, 0.5, 0.9]), rng.choice(["a", "b", "c", None])) for d in range(30) for i in range(rng.randint(1, 25))]
    df = spark.createDataFrame(rows, schema)

    def groups(d):
        some = sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], -r[3], r[1]))
        used, out = set(), []
        for i, r in enumerate(some):
            if i not in used:
                js = [i, *(j for j in range(i + 1, len(some)) if some[j][2] < r[3] and some[j][3] > r[2])]
                used |= set(js)
                out.append([some[j] for j in js])
        return out

    every = [g for d in range(30) for g in groups(d)]
    rank = {"c": 0, "a": 1}
    best = {
        "longest": lambda g: max(g, key=lambda r: r[3] - r[2]),
        "score": lambda g: max(g, key=lambda r: -1 if r[4] is None else r[4]),
        "source": lambda g: min(g, key=lambda r: rank.get(r[5], 2)),
        "first": lambda g: g[0],
        "custom": lambda g: g[-1],
    }
    for by, pick in best.items():
        got = spans.prefer(df, by, sources=("c", "a"), choose=lambda g: g[-1]).collect()
        assert sorted((r.doc_id, r.seq) for r in got) == sorted((r[0], r[1]) for r in map(pick, every)), by
    truth, said = [r for r in rows if r[1] % 2], [r for r in rows if not r[1] % 2 and r[0] != 5]
    got = {r.doc_id: r for r in spans.evaluate(spark.createDataFrame(said, schema), spark.createDataFrame(truth, schema), 0.2).collect()}
    for d in range(30):
        free, hits = [(r[2], r[3]) for r in truth if r[0] == d], []
        preds, n = [(r[2], r[3]) for r in said if r[0] == d], len([r for r in truth if r[0] == d])
        for s, e in preds:
            v = [max(0, min(e, b) - max(s, a)) / h if (h := max(e, b) - min(s, a)) > 0 else 0.0 for a, b in free]
            if v and max(v) > 0.2:
                hits.append(max(v))
                free.pop(v.index(max(v)))
        if preds or n:
            r = got[d]
            assert (r.tp, r.fp, r.fn) == (len(hits), len(preds) - len(hits), n - len(hits))
            assert abs(r.mean_iou - (sum(hits) / len(hits) if hits else 0)) < 1e-4
    assert spans.prefer(df.limit(0)).count() == 0


def test_dedup_paths_agree(spark):
    rng = random.Random(5)
    words = ["Ana", "Souza", "Lima", "Braga", "João"]
    rows = [(rng.randint(0, 9), i, rng.choice(["NOME", "TELEFONE", "ENDERECO_RESIDENCIAL", "CPF"]), " ".join(rng.sample(words, rng.randint(1, 4))) if i % 2 else "6199998888"[: rng.randint(2, 10)], 0.9, rng.randint(2, 5), rng.choice(["regex", "gatilho"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, seq long, tipo string, valor string, confianca double, peso int, source string")
    name, phone, address = F.col("tipo") == "NOME", F.col("tipo") == "TELEFONE", F.col("tipo") == "ENDERECO_RESIDENCIAL"
    apart = dedup.dedup_names(df.where(name)).unionByName(dedup.dedup_phones(df.where(phone))).unionByName(dedup.dedup_addresses(df.where(address))).unionByName(dedup.dedup_exact(df.where(~(name | phone | address))))
    assert sorted(r.seq for r in dedup.dedup(df).collect()) == sorted(r.seq for r in apart.collect())


def test_limiter_forgets_refused_requests(spark):
    rng = random.Random(9)
    rows = sorted((rng.choice("ab"), rng.randint(0, 300), i) for i in range(200))
    df = spark.createDataFrame([(ip, i, t) for ip, t, i in rows], "ip string, event_id long, t long").select("ip", "event_id", F.timestamp_seconds("t").alias("ts"))
    got = {r.event_id: r.aceito for r in access.limited(df, 60, 5).collect()}
    for ip in "ab":
        # equal times may come in any order, so count them by time
        times, want = [], {}
        for _, t, i in (r for r in rows if r[0] == ip):
            times = [x for x in times if x > t - 60]
            want[i] = len(times) < 5
            times += [t] * want[i]
        by = lambda d: sorted((t, d[i]) for p, t, i in rows if p == ip)  # noqa: E731, B023
        assert by(got) == by(want)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Protocolo,Texto Mascarado\n7,"linha um\nlinha dois"\n8,   \n9,fim\n')
    sheet = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert [(r.id, r.text) for r in files.documents(sheet).orderBy("row").collect()] == [("7", "linha um\nlinha dois"), ("9", "fim")]
    assert [tuple(r) for r in files.violations(sheet, "Protocolo", "Texto Mascarado").collect()] == [(3, "texto")]
    assert files.normal_heading("Texto-Mascarado 1") == "textomascarado1"
    with pytest.raises(ValueError):
        files.read_inline(spark, [{"id": i, "text": "x"} for i in range(201)])
    (tmp_path / "g.json").write_text('{"orgaos": [{"nome": "Casa", "sigla": "C", "aliases": ["Lar"]}]}')
    assert sorted(r.termo for r in files.gazetteer(spark, str(tmp_path / "g.json")).collect()) == ["c", "casa", "lar"]


def test_isotonic_is_monotone(spark):
    rng = random.Random(2)
    rows = [("regex", "CPF", s := rng.random(), int(rng.random() < s)) for _ in range(200)] + [("rare", "CPF", 0.5, 1)] * 3
    df = spark.createDataFrame(rows, "fonte string, tipo string, score double, label int")
    points = feedback.isotonic(df).orderBy("x").collect()
    ys = [p.y for p in points]
    assert {p.fonte for p in points} == {"regex"} and ys == sorted(ys) and 0.001 <= ys[0] and ys[-1] <= 0.999
    out = feedback.calibrated(df, feedback.isotonic(df)).collect()
    assert len(out) == len(rows) and all(0 <= r.calibrado <= 1 for r in out)


def test_isotonic_equals_a_plain_fit(spark):
    import numpy as np

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), s, int(rng.random() < s)) for _ in range(3000) for s in [rng.choice([rng.random(), round(rng.random(), 1), 0.98])]]
    rows += [("a", None, 1), ("a", 0.5, None), ("a", float("nan"), 1), ("rare", 0.5, 1)] + [("even", 0.1 * i, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "fonte string, score double, label int").repartition(7)
    got = {}
    for r in feedback.isotonic_blocks(df).collect():
        got.setdefault(r.fonte, []).append((r.first, r.last, r.total, r["count"]))
    for source in {r[0] for r in rows}:
        blocks = []
        for x, y in sorted((x, y) for f, x, y in rows if f == source and x is not None and x == x and y is not None):
            if blocks and blocks[-1][1] == x:
                blocks[-1] = [blocks[-1][0], x, blocks[-1][2] + y, blocks[-1][3] + 1]
            else:
                blocks.append([x, x, y, 1])
        i = 0
        while i + 1 < len(blocks):
            a, b = blocks[i], blocks[i + 1]
            if a[2] * b[3] >= b[2] * a[3]:
                blocks[i : i + 2] = [[a[0], b[1], a[2] + b[2], a[3] + b[3]]]
                i = max(0, i - 1)
            else:
                i += 1
        assert sorted(got[source]) == [tuple(b) for b in blocks]
    points = feedback.isotonic(df).where("fonte = 'a'").orderBy("x").collect()
    asked = spark.createDataFrame([("a", x) for x in (-0.5, 0.0, 0.2, 0.31234, 0.98, 1.0, 1.5, None)] + [("new", 0.97)], "fonte string, score double")
    out = {(r.fonte, r.score): r.calibrado for r in feedback.calibrated(asked, feedback.isotonic(df)).collect()}
    for x in (-0.5, 0.0, 0.2, 0.31234, 0.98, 1.0, 1.5):
        assert abs(out["a", x] - np.interp(x, [p.x for p in points], [p.y for p in points])) < 1e-12
    assert out["a", None] is None and abs(out["new", 0.97] - 0.88) < 1e-9
    assert feedback.isotonic(df.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    from peneira.streaming.documents import detect_stream, document_stream

    docs = spark.createDataFrame([(1, "Meu CPF é 529.982.247-25"), (2, "nada de pessoal aqui")], "doc_id long, text string").withColumn("ts", F.current_timestamp())
    docs.write.parquet(str(tmp_path / "in"))
    seen = []
    q = detect_stream(document_stream(spark, str(tmp_path / "in")), lambda df, n: seen.extend((r.doc_id, r.has_pii) for r in df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [(1, True), (2, False)]
