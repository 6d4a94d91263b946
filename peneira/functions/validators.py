"""Check digits of Brazilian identifiers and payment cards, as column expressions.

All take a column with or without separators and return a boolean that is never
null for a value (null for null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peneira.functions.normalize import as_column


def digits(value: Column | str) -> Column:
    return F.regexp_replace(as_column(value), "[^0-9]", "")


def _numbers(d: Column) -> Column:
    return F.transform(F.filter(F.split(d, ""), lambda x: x != ""), lambda x: x.cast("int"))


def _weighted(d: Column, weights: list[int]) -> Column:
    """Sum of the first digits times ``weights``."""
    n = F.slice(_numbers(d), 1, len(weights))
    pairs = F.zip_with(n, F.array(*(F.lit(w) for w in weights)), lambda a, b: F.coalesce(a * b, F.lit(0)))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).cast("int")


def uniform(d: Column) -> Column:
    """Whether all digits are the same."""
    return d == F.repeat(F.substring(d, 1, 1), F.length(d))


def _shaped(d: Column, n: int, test: Column) -> Column:
    return F.when(d.isNull(), F.lit(None)).when((F.length(d) != n) | uniform(d), False).otherwise(test)


def cpf_shape(value: Column | str) -> Column:
    """Eleven digits, not all the same."""
    d = digits(value)
    return _shaped(d, 11, F.lit(True))


def cpf_valid(value: Column | str) -> Column:
    d = digits(value)

    def check(n: int) -> Column:
        rest = _weighted(d, list(range(n + 1, 1, -1))) * 10 % 11
        return F.when(rest >= 10, 0).otherwise(rest)

    return _shaped(d, 11, (check(9) == _digit(d, 9)) & (check(10) == _digit(d, 10)))


def cnpj_valid(value: Column | str) -> Column:
    d = digits(value)
    weights = [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]

    def check(n: int) -> Column:
        rest = 11 - _weighted(d, weights[13 - n :]) % 11
        return F.when(rest >= 10, 0).otherwise(rest)

    return _shaped(d, 14, (check(12) == _digit(d, 12)) & (check(13) == _digit(d, 13)))


def pis_valid(value: Column | str) -> Column:
    d = digits(value)
    rest = _weighted(d, [3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return _shaped(d, 11, F.when(rest < 2, 0).otherwise(11 - rest) == _digit(d, 10))


def cns_valid(value: Column | str) -> Column:
    d = digits(value)
    good = d.rlike("^[12789]") & (_weighted(d, list(range(15, 0, -1))) % 11 == 0)
    return F.when(d.isNull(), F.lit(None)).when(F.length(d) != 15, False).otherwise(good)


def voter_valid(value: Column | str) -> Column:
    """Voter registration: the two first state codes take 1 where the others take 0."""
    d = digits(value)
    state = F.substring(d, 9, 2).cast("int")
    rest = _weighted(d, list(range(2, 10))) % 11
    first = F.when((rest == 0) & state.isin(1, 2), 1).when(rest < 2, 0).otherwise(11 - rest)
    again = (_digit(d, 8) * 7 + _digit(d, 9) * 8 + first * 9) % 11
    second = F.when(again < 2, 0).otherwise(11 - again)
    good = state.between(1, 28) & (_digit(d, 10) == first) & (_digit(d, 11) == second)
    return F.when(d.isNull(), F.lit(None)).when(F.length(d) != 12, False).otherwise(good)


def luhn_valid(value: Column | str) -> Column:
    """13 to 19 digits with a right checksum."""
    d = digits(value)
    doubled = F.transform(F.reverse(_numbers(d)), lambda x, i: F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + x)
    return F.when(d.isNull(), F.lit(None)).otherwise(F.length(d).between(13, 19) & (total % 10 == 0))


VALIDATORS = {
    "CPF": cpf_valid,
    "CNPJ": cnpj_valid,
    "CNPJ_PESSOAL": cnpj_valid,
    "PIS": pis_valid,
    "CNS": cns_valid,
    "TITULO_ELEITOR": voter_valid,
    "CARTAO_CREDITO": luhn_valid,
}


def valid_by_type(kind: Column | str, value: Column | str) -> Column:
    """The check for the kind; null for kinds without one."""
    out = F.lit(None).cast("boolean")
    for name, check in VALIDATORS.items():
        out = F.when(F.upper(as_column(kind)) == name, F.coalesce(check(value), F.lit(False))).otherwise(out)
    return out


def check_confidence(kind: Column | str, value: Column | str) -> Column:
    """.9999 for a right check digit, .0001 for a wrong one, .5 where there is none."""
    ok = valid_by_type(kind, value)
    return F.when(ok.isNull(), 0.5).when(ok, 0.9999).otherwise(0.0001).cast("double")


def iban_valid(value) -> object:
    """Whether an IBAN's remainder by 97 is 1, as a column expression."""
    v = F.upper(F.regexp_replace(value, r"\s", ""))
    turned = F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4))
    digits = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string")))
    rest = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: (a * F.when(F.length(d) == 2, 100).otherwise(10) + d.cast("long")) % 97)
    return v.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (rest == 1)
