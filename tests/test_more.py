"""Folding, row numbers, statistics, span cuts, removal of duplicates, presets, exports and calibration runs."""

import json
import random

from pyspark.sql import functions as F

from peneira.functions import plugins
from peneira.functions.normalize import fold, fold_lower
from peneira.operators import dedup, names, packs, spans
from peneira.plans import feedback, metrics
from peneira.plans.detect import Engine, analyze, findings
from peneira.sources import files


def test_fold_keeps_places(spark):
    odd = [chr(i) for i in range(32, 0x10000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c,) for c in odd], "c string").select("c", F.length(fold(F.concat("c", F.lit("x")))).alias("n"), F.length(fold_lower(F.concat("c", F.lit("x")))).alias("m")).where("n <> 2 or m <> 2").collect()
    assert rows == []
    text = "ß" * 10 + " quero falar com Maria Souza Lima"
    found = names.trigger_names(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("valor", "inicio").collect()
    # places count from the end of the trigger, without the blank after it
    assert [tuple(r) for r in found][:1] == [("Maria Souza Lima", text.index("Maria") - 1)]


def test_rows_are_numbered_over_partitions(spark):
    rows = [(f"r{i}", "" if i == 7 else f"texto {i}") for i in range(10)]
    sheet = spark.createDataFrame(rows, "protocolo string, texto string").repartitionByRange(4, "protocolo").sortWithinPartitions("protocolo")
    assert [(r.row, r.text) for r in files.documents(sheet).orderBy("row").collect()] == [(i, f"texto {i}") for i in range(10) if i != 7]
    assert [tuple(r) for r in files.violations(sheet, "protocolo", "texto").collect()] == [(9, "texto")]
    assert [r.id for r in files.documents(sheet.select("texto")).orderBy("row").collect()] == [str(i + 1) for i in range(10) if i != 7]


def test_statistics_of_exact_values(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 500):
        values = [0.89996, 0.69996, 0.9, 0.7, *(rng.random() for _ in range(n))][-n - (n > 4) * 4 :]
        r = metrics.confidence_statistics(spark.createDataFrame([(v,) for v in values], "confianca double")).first()
        assert r.mediana == sorted(values)[len(values) // 2] and abs(r.media - sum(values) / len(values)) < 1e-6
        assert (r.acima, r.abaixo) == (sum(v >= 0.9 for v in values), sum(v < 0.7 for v in values))


def test_span_cuts(spark):
    rows = [(1, 0, 5, 1, "ab,cd ef"), (1, 5, 8, 2, "ab,cd ef"), (2, 0, 1, 1, "xyz"), (2, 0, 3, 2, "xyz")]
    df = spark.createDataFrame(rows, "doc_id long, s int, e int, seq int, text string")
    cut = lambda **k: sorted(tuple(r) for r in spans.post_process(df, **k).collect())
    assert cut() == [(1, 0, 8), (2, 0, 3)]
    assert cut(split_on="[a-z]+") == [(1, 0, 2), (1, 3, 5), (1, 6, 8), (2, 0, 3)]
    assert cut(split_on="[0-9]") == [(1, 0, 8), (2, 0, 3)]
    assert cut(merge=False, split_on="[a-f]+") == [(1, 0, 2), (1, 3, 5), (1, 6, 8), (2, 0, 3)]
    assert cut(split_on=lambda s, e, t: [(s, s + 1)] if "," in t else []) == [(1, 0, 1), (2, 0, 3)]


def test_one_pass_of_dedup_equals_the_rules(spark):
    rng = random.Random(2)
    rows = []
    for doc in range(40):
        for seq in range(rng.randint(1, 14)):
            kind = rng.choice(["NOME", "TELEFONE", "ENDERECO_RESIDENCIAL", "CPF"])
            value = {"NOME": " ".join(rng.choices(["Ana", "Lima", "Souza", "ana", "cpf"], k=rng.randint(1, 4))), "TELEFONE": "61999887766"[rng.randint(0, 5) : rng.randint(6, 11)], "ENDERECO_RESIDENCIAL": "Rua A casa 12"[: rng.randint(4, 13)], "CPF": rng.choice(["1", "2", " "])}[kind]
            rows.append((doc, seq, kind, value, 0.5, rng.randint(1, 5), rng.choice(["regex", "gatilho"])))
    df = spark.createDataFrame(rows, "doc_id long, seq int, tipo string, valor string, confianca double, peso int, source string")
    key = lambda d: sorted((r.doc_id, r.seq) for r in d.collect())
    parts = [dedup.dedup_names(df.where("tipo = 'NOME'")), dedup.dedup_phones(df.where("tipo = 'TELEFONE'")), dedup.dedup_addresses(df.where("tipo = 'ENDERECO_RESIDENCIAL'")), dedup.dedup_exact(df.where("tipo = 'CPF'"))]
    assert key(dedup.dedup(df)) == sorted(x for p in parts for x in key(p))


def test_many_findings_of_a_document(spark):
    rows = [(1, i, "TELEFONE", f"61{900000000 + i}", 0.9, 3, "regex") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, seq int, tipo string, valor string, confianca double, peso int, source string")
    assert dedup.dedup(df).count() == 4000


def test_presets_and_complement(spark):
    text = "Meu telefone: +55 61 98888-7777. Conta internacional BR15 0000 0000 0000 1093 2840 814P 2 e cartão 4111 1111 1111 1111"
    docs = spark.createDataFrame([(1, text), (2, "nada de pessoal neste pedido")], "doc_id long, text string")
    plain = findings(docs).collect()
    assert any(r.tipo == "CONTA_BANCARIA_INTERNACIONAL" and r.source == "presidio" for r in plain)
    assert not any(r.source == "presidio" for r in findings(docs, Engine(complement=False)).collect())
    assert {r.tipo for r in plugins.complement(docs, everything=True).collect()} == {"CONTA_BANCARIA_INTERNACIONAL", "CARTAO_CREDITO"}
    pairs = lambda rows: [(a, b) for a in rows for b in rows if a.seq < b.seq and a.inicio < b.fim and b.inicio < a.fim]
    # a number inside the longer one goes with a preset only
    over = spark.createDataFrame([(1, "Moro na rua Sete casa 12, inquilina da CLN 110 Bloco B sala 12")], "doc_id long, text string")
    for preset in ("recall", "precision", "f1"):
        rows = findings(over, Engine(merge_preset=preset)).collect()
        assert rows and not pairs(rows)
    kept = findings(over, Engine(merge_preset="custom", choose=lambda group: min(group, key=lambda x: x["seq"]))).collect()
    assert kept and not pairs(kept)
    assert {r.doc_id: r.has_pii for r in analyze(docs, Engine(merge_preset="f1")).collect()} == {1: True, 2: False}


def test_scored_pack_filters_entities(spark):
    docs = spark.createDataFrame([(1, "CPF 529.982.247-25, CEP 70000-000, LAI-123456")], "doc_id long, text string")
    assert {r.entity for r in packs.scored(docs).collect()} >= {"CPF_BR", "CEP_BR", "PROTOCOLO_LAI"}
    assert {r.entity for r in packs.scored(docs, ["CPF_BR"]).collect()} == {"CPF_BR"} and packs.scored(docs, ["NADA"]).count() == 0
    assert [r.value for r in packs.scored(docs, least=0.9).where("entity = 'CPF_BR'").collect()] == ["529.982.247-25"]


def test_exports(spark, tmp_path):
    row = [(1, "individual", "texto longo " * 20, "NÃO PÚBLICO", "CRITICO", 0.987, [("CPF", "1"), ("NOME", "a; b")])]
    df = spark.createDataFrame(row, "id long, type string, text string, classificacao string, risco string, confianca double, entities array<struct<tipo:string,valor:string>>").withColumn("ts", F.lit("2024-03-07 09:05:00").cast("timestamp"))
    out = files.export_rows(df)
    assert out.columns == ["ID", "Data", "Horário", "Tipo", "Classificação", "Confiança", "Risco", "Nível de Risco", "Prévia do Pedido", "Dados Identificados"]
    assert tuple(out.first())[:8] == (1, "07/03/2024", "09:05", "Individual", "NÃO PÚBLICO", "98.7%", "0.99", "Crítico") and out.first()[9] == "CPF: 1; NOME: a; b"
    files.write_report(out, str(tmp_path / "csv"))
    raw = next(x for x in (p.read_bytes() for p in (tmp_path / "csv").glob("*.csv")) if x)
    assert raw.startswith(b"\xef\xbb\xbf") and b"ID;Data;" in raw
    files.write_json(files.report_json(df), str(tmp_path / "json"))
    files.write_json(files.report_json(df), str(tmp_path / "one"), one_file=True)
    lines = [[x for p in (tmp_path / name).glob("*.json") for x in p.read_text().splitlines()] for name in ("json", "one")]
    assert len(lines[0]) == 1 and lines[0] == lines[1] and len(list((tmp_path / "one").glob("*.json"))) == 1
    got = json.loads(lines[0][0])
    assert got["nivel_risco"] == "critical" and len(got["dados_identificados"]) == 2 and got["previa_pedido"].endswith("...")
    fb = spark.createDataFrame([(1, "CPF", "regex", 0.9, "CORRETO")], "fb_id long, tipo string, fonte string, confianca_modelo double, validacao_humana string")
    files.write_feedback_export(fb, str(tmp_path / "fb"))
    assert len(list((tmp_path / "fb" / "feedbacks").glob("*.json"))) >= 1 and spark.read.json(str(tmp_path / "fb" / "stats")).count() == 2


def test_pooling_equals_the_least_squares_fit(spark):
    rng = random.Random(3)
    for _ in range(20):
        xs = sorted({round(rng.random(), 2) for _ in range(rng.randint(1, 9))})
        rows = [(x, rng.randint(0, n), n) for x in xs for n in [rng.randint(1, 4)]]
        blocks = feedback._pooled([], ((x, x, total, n) for x, total, n in rows))
        points = {x: total / n for first, last, total, n in blocks for x in (first, last)}
        # the greatest mean from any start at or before a place, over the least to any end at or after it
        mean = lambda i, j: sum(y for _, y, _ in rows[i : j + 1]) / sum(n for *_, n in rows[i : j + 1])
        for k, (x, *_) in enumerate(rows):
            if x in points:
                assert abs(points[x] - max(min(mean(i, j) for j in range(k, len(rows))) for i in range(k + 1))) < 1e-9


def test_recalibration(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["CPF", "NOME"]), f := rng.choice(["regex", "spacy"]), s := rng.random(), "CORRETO" if (rng.random() < s) == (f == "regex") else rng.choice(["INCORRETO", "PARCIAL"])) for i in range(400)]
    rows += [(900 + i, "CPF", "rare", 0.5, "CORRETO") for i in range(3)]
    fb = spark.createDataFrame(rows, "fb_id long, tipo string, fonte string, confianca_modelo double, validacao_humana string")
    points, history = feedback.recalibrate(fb)
    got = {r.fonte: r for r in history.collect()}
    assert got.keys() == {"regex", "spacy"} and {r.fonte for r in points.select("fonte").distinct().collect()} == {"regex", "spacy"}
    for f, r in got.items():
        mine = [(s, v == "CORRETO") for *_, g, s, v in rows if g == f]
        assert r.amostras == len(mine) and r.acuracia_antes == round(sum((s >= 0.5) == y for s, y in mine) / len(mine), 4)
        assert r.acuracia_depois >= r.acuracia_antes and r.melhora == round(r.acuracia_depois - r.acuracia_antes, 4)
        assert sum(x.total for x in r.por_tipo.values()) == len(rows)
    assert feedback.recalibrate(fb.limit(9))[1].count() == 0
