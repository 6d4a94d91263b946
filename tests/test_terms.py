"""Terms in texts against a search at every place, and names that a gazetteer takes out."""

import random
import re

from pyspark.sql import functions as F

from peneira.operators import terms
from peneira.plans.detect import Engine, findings


def _plain(text):
    return re.findall(r"[^\W_]+", (text or "").upper().translate(str.maketrans("ÁÃÇÉ", "AACE")))


def _brute(texts, listed):
    out = []
    for i, t in texts:
        w = _plain(t)
        for term in {x for x in listed if x is not None}:
            n = len(v := _plain(term))
            out += [(i, term, a) for a in range(len(w) - n + 1) if n and w[a : a + n] == v]
    return sorted(out)


def test_find_at_every_place(spark):
    rng = random.Random(4)
    some = ["casa", "Maçã", "de", "sol", "rio", "É", "2024", "mar"]
    said = lambda n: rng.choice([" ", ", ", "-", "  "]).join(rng.choice(some) for _ in range(n))
    listed = [said(rng.randint(1, 4)) for _ in range(60)] + ["", None, "--", "de de", "DE-DE", "maca", "Maçã"]
    texts = [(i, said(rng.randint(0, 40))) for i in range(40)] + [(41, None), (42, ""), (43, "de de de"), (44, "??"), (7, "casa de de")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame([(x,) for x in listed], "termo string")
    want = _brute(texts, listed)
    for most in (terms.MOST_SENT, 0):
        got = sorted((r.doc_id, r.termo, r.palavra) for r in terms.find(docs, table, most_sent=most).collect())
        assert got == want
    assert terms.find(docs, table.limit(0)).count() == 0 == terms.find(docs.limit(0), table).count()


def test_index_by_rarest_word(spark):
    table = spark.createDataFrame([("secretaria de saude",), ("secretaria de obras",), ("de secretaria",)], "termo string")
    got = {r.termo: (r.palavra, r.antes, r.n) for r in terms.index(table).collect()}
    assert got == {"secretaria de saude": ("SAUDE", 2, 3), "secretaria de obras": ("OBRAS", 2, 3), "de secretaria": ("SECRETARIA", 1, 2)}


def test_a_long_text_stays_linear(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("casa de sol e mar "), 60_000).alias("text"))
    table = spark.createDataFrame([("de sol",), ("mar casa",), ("nada aqui",)], "termo string")
    got = {r.termo: r.n for r in terms.find(docs, table).groupBy("termo").agg(F.count("*").alias("n")).collect()}
    assert got == {"de sol": 60_000, "mar casa": 59_999}


def test_without_and_engine(spark):
    rows = spark.createDataFrame([(1, "NOME", "Ana da Casa Civil"), (2, "NOME", "Ana Lima"), (3, "CPF", "casa civil"), (4, "NOME", None), (5, "NOME", "Ana Casa Civilis")], "doc_id long, tipo string, valor string")
    table = spark.createDataFrame([("casa civil",)], "termo string")
    left = terms.without(rows, table, only=F.col("tipo") == "NOME")
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5] and left.columns == rows.columns
    docs = spark.createDataFrame([(1, "Fui atendido por Dra. Ana Souza Lima, sala 3"), (2, "Conversei com a servidora Paula Braga, sala 4")], "doc_id long, text string")
    named = lambda e: sorted(r.valor for r in findings(docs, e).where("tipo = 'NOME'").collect())
    assert named(Engine()) == ["Ana Souza Lima", "Paula Braga"]
    assert named(Engine(gazetteer=spark.createDataFrame([("souza lima",)], "termo string"))) == ["Paula Braga"]
