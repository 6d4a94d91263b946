from peneira.functions import confidence as C
from peneira.functions import validators as V
from peneira.functions.validators import iban_valid
from pyspark.sql import functions as F


def _values(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_check_digits(spark):
    assert _values(spark, V.cpf_valid("v"), ["529.982.247-25", "529.982.247-24", "111.111.111-11", "123", "", None]) == [True, False, False, False, False, None]
    assert _values(spark, V.cnpj_valid("v"), ["11.222.333/0001-81", "11.222.333/0001-80", None]) == [True, False, None]
    assert _values(spark, V.pis_valid("v"), ["120.56412.54-5", "120.56412.54-8"]) == [True, False]
    assert _values(spark, V.luhn_valid("v"), ["4539 1488 0343 6467", "4539 1488 0343 6468", "1"]) == [True, False, False]
    assert _values(spark, V.valid_by_type(F.lit("NOME"), F.col("v")), ["x"]) == [None]
    assert _values(spark, iban_valid(F.col("v")), ["GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"]) == [True, False]


def test_against_plain_python(spark):
    import random

    rng = random.Random(7)

    def cpf(s):
        d = [int(c) for c in s]
        ok = len(set(d)) > 1
        for n in (9, 10):
            r = sum(x * w for x, w in zip(d[:n], range(n + 1, 1, -1))) * 10 % 11
            ok &= (0 if r >= 10 else r) == d[n]
        return ok

    def voter(s):
        d = [int(c) for c in s]
        uf = d[8] * 10 + d[9]
        r = sum(d[i] * (i + 2) for i in range(8)) % 11
        a = 1 if r == 0 and uf in (1, 2) else 0 if r < 2 else 11 - r
        q = (d[8] * 7 + d[9] * 8 + a * 9) % 11
        return 1 <= uf <= 28 and d[10] == a and d[11] == (0 if q < 2 else 11 - q)

    some = ["".join(rng.choice("0123456789") for _ in range(11)) for _ in range(300)]
    assert _values(spark, V.cpf_valid("v"), some) == [cpf(x) for x in some]
    some = ["".join(rng.choice("0123456789") for _ in range(8)) + f"{rng.randint(0, 30):02d}" + "".join(rng.choice("0123456789") for _ in range(2)) for _ in range(400)]
    assert _values(spark, V.voter_valid("v"), some) == [voter(x) for x in some]


def test_levels_and_interpolation(spark):
    row = spark.range(1).select(
        C.confidence_level(F.lit(0.96)), C.conservative(F.lit(0.8999)), C.conservative(F.lit(0.90)), C.risk_of_weight(F.lit(3)),
        C.interpolate(F.lit(0.5), F.expr("array(struct(0.0D as x, 0.0D as y), struct(1.0D as x, 0.5D as y))")), C.percent(F.lit(0.987)),
        C.preview(F.lit("a" * 120)), C.elapsed(F.lit(7200)), C.shown_confidence(F.lit("PÚBLICO"), F.lit(0.0)),
    ).first()
    assert row[0] == "very_high" and abs(row[1] - 0.8799) < 1e-9 and row[2] == 0.82 and row[3] == "MODERADO"
    assert row[4] == 0.25 and row[5] == "98.7%" and row[6] == "a" * 100 + "..." and row[7] == "2 h" and row[8] == 0.99
