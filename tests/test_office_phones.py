"""Phones of offices are no findings, whatever stands before them."""

from peneira.operators.patterns import PATTERNS
from peneira.operators.rules import PHONE_PREFIXES, judge


def test_prefixes_of_offices(spark):
    said = [(i, f"Meu telefone: (61) {p}-1111") for i, p in enumerate([*PHONE_PREFIXES, "3463", "3200"])]
    docs = spark.createDataFrame(said, "doc_id long, text string")
    found = judge(docs, [p for p in PATTERNS if p.name in ("TELEFONE_FIXO", "TELEFONE_CURTO")])
    n = len(PHONE_PREFIXES)
    assert sorted((r.doc_id, r.valor) for r in found.collect()) == [(n, "(61) 3463-1111"), (n, "3463-1111"), (n + 1, "(61) 3200-1111"), (n + 1, "3200-1111")]
