"""The name tagger: Viterbi against all sequences, training, and what it finds."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from peneira.operators import tagger as T
from peneira.plans import catalog
from peneira.plans.detect import Engine, findings

FOUND = [
    ("Encaminho a resposta para Eduarda Queiroz Lins.", ["Eduarda Queiroz Lins"]),
    ("Conforme disse Rogério de Almeida Barros em reunião", ["Rogério de Almeida Barros"]),
    ("Dra Helena examinou o laudo", ["Dra Helena"]),
    ("Em nome de Tadeu Brito, solicito certidão", ["Tadeu Brito"]),
    ("A aluna Marina Peixoto foi aprovada. O professor Ivan Saldanha faltou", ["Marina Peixoto", "Ivan Saldanha"]),
]
NONE = ["A Secretaria de Educação publicou o edital", "Obras no Distrito Federal", "Solicito cópia do Diário Oficial da União", "texto comum sem nada", "", "Prezados Senhores, bom dia", "O Hospital Regional de Ceilândia está lotado"]


TABLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def weights(spark):
    rows = spark.read.parquet(f"{TABLE}/orders.parquet")
    return T.train(T.starting_texts(F.col("o_orderkey"), rows))


def test_viterbi_equals_all_sequences():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 6)
        rows = [[f"f{rng.randint(0, 5)}" for _ in range(3)] for _ in range(n)]
        w = {f"f{i}": [rng.randint(-3, 3) + 0.0 for _ in range(3)] for i in range(5)} | {f"t={i}": [rng.randint(-2, 2) + 0.0 for _ in range(3)] for i in range(3)}
        tags, score = T.viterbi(w, rows)
        best = max(T.sequence_score(w, rows, list(x)) for x in product(range(3), repeat=n))
        assert score == best == T.sequence_score(w, rows, tags)
    assert T.viterbi({}, []) == ([], 0.0)


def test_finds_names(weights):
    assert {t: [t[a:b] for a, b in T.names_in(weights, t)] for t, _ in FOUND} == dict(FOUND)
    assert [t for t in NONE if T.names_in(weights, t)] == []


def test_engine_with_names(spark, weights):
    docs = spark.createDataFrame([*enumerate(t for t, _ in FOUND), *((100 + i, t) for i, t in enumerate(NONE)), (200, None)], "doc_id long, text string")
    got = {}
    for r in findings(docs, Engine(recognizers=(T.recognizer(weights),))).collect():
        assert r.source in ("spacy", "gatilho", "regex") and FOUND[r.doc_id][0][r.inicio : r.fim].strip() == r.valor
        got.setdefault(r.doc_id, set()).add(r.valor)
    assert all(set(names) <= got[i] for i, (_, names) in enumerate(FOUND)) and got.keys() == set(range(len(FOUND)))


def test_learns_from_feedback_and_reruns_agree(spark):
    rows = [("o zumbi Karl Otto dorme", 8, 17), ("a planta Ficus Alba cresce", None, None), ("o zumbi Kim Oto dorme", 8, 15), ("a planta Salix Nigra cresce", None, None)]
    rows += [("o zumbi Bela Lugo dorme", 8, 17), (None, 1, 2), ("dois Eva Mar e Ivo Sol aqui", 5, 12), ("dois Eva Mar e Ivo Sol aqui", 15, 22)]
    df = spark.createDataFrame(rows, "text string, inicio int, fim int")
    one, two = T.train(df.repartition(3), shards=2, rounds=6), T.train(df.repartition(2), shards=2, rounds=6)
    assert one == two
    assert T.names_in(one, "o zumbi Kurt Olaf dorme") == [(8, 17)] and T.names_in(one, "a planta Salix Nigra cresce") == []
    assert T.train(df.where("false")) == {}


def test_held_out(spark):
    r = catalog.QUERIES["tagger_held_out"](spark, TABLE).first()
    assert r.certos >= 0.95 * (r.certos + r.faltam) and r.a_mais <= 0.05 * r.certos
