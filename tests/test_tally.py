"""Sums of terms by text against a search at every place, by whichever way the windows go."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from peneira.functions.normalize import fold
from peneira.operators import tally, terms
from peneira.plans.catalog import QUERIES


def _by_find(docs, table):
    found = terms.find(docs, table)
    return sorted(tuple(r) for r in found.groupBy("doc_id").agg(F.count("*"), F.count_distinct("termo"), F.min("palavra")).collect())


@pytest.mark.parametrize("few", [0, tally.FEW])
def test_tally_equals_find(spark, few, monkeypatch):
    monkeypatch.setattr(tally, "FEW", few)
    said = ["de", "Maçã", "sol", "É", "2024", "25°", "a_b", "x\0y", "ß", "Ⱟ"]
    docs = [(i, " ".join(said[(i * j + j // 3) % len(said)] for j in range(i % 30))) for i in range(90)]
    docs = spark.createDataFrame([*docs, (5, "de sol de sol"), (91, None), (92, ""), (None, "de sol"), (None, "sol"), (93, "??")], "doc_id long, text string").repartition(3, "doc_id")
    table = spark.createDataFrame([(x,) for x in ["de sol", "DE-SOL", "sol", "maca", "Maçã", "b x", "x", "25o", "É 2024", "de maçã 2024", "ss", "s", "a", "Ⱟ", "", None, "--", "nada aqui"]], "termo string").repartition(2)
    got = sorted((tuple(r) for r in tally.tally(docs, table).collect()), key=lambda r: (r[0] is not None, r))
    find = docs.where("doc_id is not null")
    assert [r for r in got if r[0] is not None] == _by_find(find, table)
    assert [r for r in got if r[0] is None] == [(None, 4, 3, 0)]
    assert tally.tally(docs, table.limit(0)).count() == 0 == tally.tally(docs.limit(0), table).count()


def test_letters_are_sparks(spark):
    usual, whole, strange = (letters := tally.Letters(spark)).expressions()
    some = [*range(0x20, 0x250), 0x345, 0x2160, 0x2C2F, 0x3042, 0x4E00, 0xA7C0, 0x10570, *map(ord, sorted(letters.strange)[:50])]
    rows = spark.createDataFrame([(chr(i),) for i in some], "c string").select("c", terms.words("c").alias("w"), fold("c").alias("f")).collect()
    for r in rows:
        assert [tally.fold(x) for x in whole.findall(r.c)] == r.w
        assert r.c in strange or usual.findall(r.c) == whole.findall(r.c)


def test_query_makes_no_row_of_each_word(spark, sf_dir):
    plan = QUERIES["gazetteer_terms"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert Counter(w for w in ("SortMergeJoin", "BroadcastHashJoin", "Generate") for _ in range(plan.count(w))) == {}
