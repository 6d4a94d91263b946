"""Goldens for rules and the whole engine: own sentences that need no name model."""

import random
import re

import pytest
from pyspark.sql import functions as F

from peneira.operators.patterns import PATTERNS, SILENT
from peneira.operators.rules import judge
from peneira.operators.scan import scan
from peneira.plans.detect import Engine, analyze, detect_extended, findings

CASES = [
    ("Meu CPF é 529.982.247-25", {("CPF", "529.982.247-25", 5)}),
    ("Meu CPF é 529.982.247-24", {("CPF", "529.982.247-24", 3)}),
    ("Exemplo de CPF: 529.982.247-25", set()),
    ("O processo 529.982.247-25 foi arquivado", set()),
    ("Contato: ouvidoria@saude.df.gov.br", set()),
    ("Escreva para joana.silva@gmail.com hoje", {("EMAIL_PESSOAL", "joana.silva@gmail.com", 4)}),
    ("Meu celular: (61) 99999-8888", {("TELEFONE", "(61) 99999-8888", 4)}),
    ("Ramal da secretaria: (61) 3105-1234", set()),
    ("Solicito acesso ao Processo SEI 00015-01009853/2024-01", {("PROCESSO_SEI", "00015-01009853/2024-01", 3)}),
    ("Decreto 00015-01009853/2024-01 de ontem", set()),
    ("Minha CNH: 12345678901", {("CNH", "12345678901", 5)}),
    ("Boleto, codigo de barras CNH: 12345678901", set()),
    ("Paciente Pedro Lima, 8 anos", {("MENOR_IDENTIFICADO", "Pedro Lima 8", 5)}),
    ("Paciente Pedro Lima, 38 anos", set()),
    ("Dona Lúcia, CID F32", {("DADO_SAUDE", "CID F32", 5)}),
    ("Prof. Ana Lima falou", {("NOME", "Ana Lima", 4)}),
    ("Peço retorno. Atenciosamente, João Carlos Silva", {("NOME", "João Carlos Silva", 4)}),
    ("Me chamo Maria Souza e moro na quadra 12", {("NOME", "Maria Souza", 4), ("ENDERECO_RESIDENCIAL", "moro na quadra 12", 4)}),
    ("Conta corrente 12345-6 Ag 0001", {("CONTA_BANCARIA", "Conta 12345-6 Ag 0001", 5), ("DADOS_BANCARIOS", "Agência 12345-6 Conta 0001", 4)}),
    ("Acesso de 10.1.0.7 e 127.0.0.1", {("IP_ADDRESS", "10.1.0.7", 2)}),
    ("SAS QUADRA 15 BLC A, reclamação de buraco", set()),
    ("😀 Meu CPF é 529.982.247-25", {("CPF", "529.982.247-25", 5)}),
    ("Sem dado pessoal aqui, obrigado", set()),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(100, None), (101, ""), (102, "curto"), (103, "palavra " * 20_000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def found(docs):
    return findings(docs).collect()


def test_rules(found):
    got = {i: set() for i in range(len(CASES))}
    for r in found:
        got[r.doc_id].add((r.tipo, r.valor, r.peso))
    assert {i: v for i, v in got.items() if v != CASES[i][1]} == {}


def test_spans_are_code_points(found):
    by = {r.doc_id: r for r in found if r.tipo == "CPF"}
    last = next(i for i, (t, _) in enumerate(CASES) if t.startswith("😀"))
    assert CASES[last][0][by[last].inicio : by[last].fim] == "529.982.247-25"


def test_explanations(found):
    cpf = next(r for r in found if r.doc_id == 0)
    assert cpf.explicacao.motivos[0].startswith("✓ Formato XXX") and cpf.explicacao.validacoes == ["✓ Dígito verificador válido (mod 11)"]
    assert cpf.explicacao.contexto == ["✓ Contexto pessoal: 'meu' encontrado"] and cpf.explicacao.fontes == ["Regex (padrão)"]


def test_service_answers(docs):
    rows = {r.doc_id: r for r in analyze(docs).collect()}
    assert len(rows) == len(CASES) + 4
    assert (rows[0].risco, rows[0].classificacao) == ("CRITICO", "NÃO PÚBLICO")
    assert [(rows[i].risco, rows[i].valid_for_stats) for i in (100, 101, 102)] == [("BAIXO", False)] * 3
    assert (rows[103].has_pii, rows[103].risco, rows[103].confianca) == (False, "SEGURO", 1.0)


def test_extended(docs):
    rows = {r.doc_id: r for r in detect_extended(docs.where("doc_id in (0, 22, 101)")).collect()}
    assert rows[0].confidence.no_pii is None and rows[0].confidence.all_found == pytest.approx(1.0)
    assert rows[22].confidence.no_pii == 0.0 and rows[101].confidence.no_pii == 0.9999


def test_plugins(spark):
    docs = spark.createDataFrame([(1, "Falei ontem com Ana Souza sobre o caso"), (2, "nada de mais por aqui")], "doc_id long, text string")
    from peneira.functions.plugins import name_recognizer

    def load():
        return lambda t: [(m.start(), m.end(), 0.9) for m in re.finditer("Ana Souza", t)]

    got = findings(docs, Engine(recognizers=(name_recognizer(load, "bert"),))).collect()
    assert [(r.doc_id, r.valor, r.source) for r in got] == [(1, "Ana Souza", "bert")]


def test_scanner_equals_python(spark, sf_dir):
    """Same matches and spans as Python's own engine."""
    every = (*PATTERNS, *SILENT)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")).cache()
    got = sorted((r.doc_id, r.name, r.inicio, r.fim, r.m) for r in scan(docs, every).drop("text").collect())
    want = [(d.doc_id, p.name, m.start(), m.end(), m.group()) for d in docs.collect() for p in every for m in re.compile(p.regex, re.I if p.any_case else 0).finditer(d.text)]
    assert got == sorted(want)


def test_clean_documents_stay_clean(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("texto comum sem nada de pessoal").alias("text"))
    assert findings(docs).count() == 0


def test_mail_behind_an_office_in_its_line(spark):
    """Hiding an @ equals looking ahead from it."""
    mail = next(p for p in PATTERNS if p.name == "EMAIL_PESSOAL")
    parts = ["ana@x.com", "b@y.GOV.br", "c.d@z.org.br.e@w.net", " ", "\n", "\r", "Edu.br", ".edu.br", "@", "f@g.com@h.io", "x\x01y@z.de", "é@ç.com"]
    rng = random.Random(6)
    texts = ["", *parts, *("".join(rng.choices(parts, k=rng.randint(2, 9))) for _ in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.inicio, r.fim, r.m, r.g1) for r in scan(docs, [mail]).collect())
    assert got == sorted((i, m.start(), m.end(), m.group(), m.group(1)) for i, t in enumerate(texts) for m in re.compile(mail.regex, re.I).finditer(t))


def test_slices_equal_whole_texts(spark):
    """A case far inside a long text is judged as alone, with what stands around it."""
    filler = "palavras comuns sem nada de mais " * 130
    cut = "\n\n" + "x" * 200 + "\n\n"
    picked = [i for i, (t, _) in enumerate(CASES) if "\n" not in t and not t.startswith("Sem dado")]
    rows = [(1000 + i, filler + cut + CASES[i][0] + cut + filler) for i in picked] + [(i, cut + CASES[i][0] + cut) for i in picked]
    got = {}
    for r in judge(spark.createDataFrame(rows, "doc_id long, text string"), PATTERNS).collect():
        low = len(filler) if r.doc_id >= 1000 else 0
        got.setdefault(r.doc_id, set()).add((r.tipo, r.valor, r.peso, round(r.confianca, 9), r.inicio - low, r.contexto))
    assert {i: got.get(1000 + i) for i in picked} == {i: got.get(i) for i in picked} and sum(map(len, got.values())) > 20


def test_fiction_beside_the_first_place_of_a_number(spark):
    far = " . " * 60
    texts = ["Exemplo 529.982.247-25" + far + "cpf: 529.982.247-25", "cpf: 529.982.247-25" + far + "exemplo 529.982.247-25", "x529.982.247-25 falso" + far + "cpf: 529.982.247-25", "cpf: 529.982.247-25" + far + "exemplo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.inicio) for r in judge(docs, PATTERNS).where("tipo = 'CPF'").collect()) == [(1, 5), (1, 207), (3, 5)]


def test_work_on_a_long_text_is_linear(spark):
    import time

    mail = lambda n: spark.createDataFrame([(1, " ".join(f"escreva a pessoa{i}.lima@gmail.com sobre o pedido feito ontem aqui" for i in range(n)))], "doc_id long, text string")
    judge(mail(10), PATTERNS).count()
    took = []
    for n in (500, 4000):
        began = time.time()
        assert judge(mail(n), PATTERNS).count() == n
        took.append(time.time() - began)
    # eight times the text; the square would be 64 times
    assert took[1] < 24 * took[0]
