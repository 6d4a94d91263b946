"""No test in front of a pattern hides a match."""

import re
import warnings

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peneira.operators import guards
from peneira.operators.patterns import PATTERNS, SILENT
from peneira.operators.scan import DIGITS, LOW, find_all


def examples(pattern, n=25):
    out = []

    @settings(max_examples=n, database=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck), deadline=None)
    @given(st.from_regex(re.compile(pattern.regex, re.IGNORECASE if pattern.any_case else 0)))
    def take(x):
        out.append(x[:400].replace("\x00", " "))

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        take()
    return out


def test_guarded_scan_equals_plain_scan(spark):
    every = PATTERNS + SILENT
    rows = [(i, x) for i, p in enumerate(every) for x in examples(p)]
    rows += [(0, "CPF ٥٢٩٩٨٢٢٤٧٢٥"), (1, "proceſſo"), (2, "Kunde"), (3, ""), (4, "CİD F10 e dıagnóstico"), (5, "PAſSAPORTE AB123456")]
    docs = spark.createDataFrame(rows, "p int, text string").withColumns({LOW: guards.folded(F.col("text")), DIGITS: guards.n_digits(F.col("text"))}).cache()
    met = 0
    for i, p in enumerate(every):
        mine = docs.where((F.col("p") == i) | (F.col("p") < 6))
        tested, plain = find_all(F.col("text"), p, i), find_all(F.col("text"), p, i, guarded=False)
        r = mine.agg(F.count_if(~tested.eqNullSafe(plain)).alias("bad"), F.count_if(F.size(plain) > 0).alias("met")).first()
        assert r.bad == 0, p.name
        met += r.met > 0
    assert met > 50


def test_needs_are_told_by_the_syntax():
    assert guards.needs(r"\b(\d{3}[.]?\d{3})-(?:ab|cd)\d?") == (6, ("ab", "cd"))
    assert guards.needs(r"(?:foo)?x+|\d") == (0, ())
    assert guards.needs(r"[cç]ancer\s") == (0, ("cancer", "çancer"))
    assert guards.needs(r"(?!bar)[a-z]{2}(?:\d{2}|\d{4})") == (2, ())


@pytest.mark.parametrize("text", ["İıſKÅ", "ABC"])
def test_folding_is_one_for_one(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(guards.folded(F.col("t"))).first()[0] == {"ABC": "abc"}.get(text, "iiskå")
