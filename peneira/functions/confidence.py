"""Confidence of single findings, levels, calibration and risk, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peneira.functions.normalize import after, as_column, before, contains_any, fold
from peneira.operators.vocabulary import BASE_CONFIDENCE, CONTEXT_WORDS, DEFAULT_BASE, TRIGGERS

_LABELS = {
    "CPF": r"(?:CPF|C\.?P\.?F\.?)\s*:?\s*$",
    "EMAIL_PESSOAL": r"(?:E-?MAIL|CORREIO)\s*:?\s*$",
    "TELEFONE": r"(?:TEL\.?|TELEFONE|CELULAR)\s*:?\s*$",
    "RG": r"(?:RG|IDENTIDADE)\s*:?\s*$",
    "CNH": r"(?:CNH|HABILITACAO)\s*:?\s*$",
}


def lookup(table: dict, key: Column, default) -> Column:
    """The value of a literal map, or the default."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def context_factor(kind: Column, text: Column, start: Column, end: Column, window: int = 60) -> Column:
    """How what stands around a span raises or lowers its confidence: .6 to 1.2."""
    pre, post = F.trim(fold(before(text, start, window))), F.trim(fold(after(text, end, window)))
    both = F.concat(pre, F.lit(" "), post)
    labelled = F.lit(False)
    for name, label in _LABELS.items():
        labelled = labelled | ((kind == name) & pre.rlike(label))

    def points(test: Column, value: float) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.lit(0.0))

    total = (
        F.lit(1.0)
        + points(pre.rlike(r"\b(MEU|MINHA|MEUS|MINHAS)\s*:?\s*$"), 0.15)
        + points(labelled, 0.10)
        + points(F.right(pre, F.lit(20)).rlike(r"\b(E|SAO|FOI|FORAM)\s*:?\s*$"), 0.05)
        + points((kind == "NOME") & contains_any(pre, TRIGGERS), 0.10)
        - points(both.rlike(r"\b(EXEMPLO|TESTE|FICTICIO|FAKE|GENERICO)\b"), 0.25)
        - points(both.rlike(r"\b(INVALIDO|FALSO|ERRADO|INCORRETO)\b"), 0.30)
        - points(pre.rlike(r"\b(NAO|NEM)\s+(E|ERA|FOI)\s*$"), 0.20)
        - points(both.rlike(r"\b(DA EMPRESA|DO ORGAO|INSTITUCIONAL|CORPORATIVO)\b"), 0.10)
        - points(F.regexp_count(both, F.lit("[0-9]{4,}")) >= 4, 0.15)
    )
    return F.greatest(F.lit(0.6), F.least(F.lit(1.2), total))


def base_confidence(kind: Column) -> Column:
    return lookup(BASE_CONFIDENCE, kind, DEFAULT_BASE)


def finding_confidence(kind: Column, text: Column, start: Column, end: Column, base: Column | None = None) -> Column:
    """Base confidence of the kind (or ``base``) times the context factor, at most 1."""
    return F.least(F.lit(1.0), (base_confidence(kind) if base is None else base) * context_factor(kind, text, start, end))


def context_keywords(context: Column | str, kind: Column | str) -> Column:
    """.95, 1 or 1.1 for no, one or more words of the kind in the context; 1 without context."""
    low, kind = F.lower(as_column(context)), F.upper(as_column(kind))
    hits = F.lit(0)
    for name, words in CONTEXT_WORDS.items():
        count = F.lit(0)
        for w in words:
            count = count + F.contains(low, F.lit(w)).cast("int")
        hits = F.when(kind == name, count).otherwise(hits)
    return F.when(low.isNull() | (low == ""), 1.0).when(hits == 0, 0.95).when(hits == 1, 1.0).otherwise(1.1)


def confidence_level(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(c >= 0.95, "very_high").when(c >= 0.85, "high").when(c >= 0.70, "medium").when(c >= 0.50, "low").otherwise("very_low")


def conservative(score: Column | str) -> Column:
    """Calibration without a fit: five linear pieces, not monotone at their seams."""
    s = as_column(score).cast("double")
    return F.when(s >= 0.99, 0.90 + (s - 0.99) * 2.0).when(s >= 0.95, 0.85 + (s - 0.95) * 1.5).when(s >= 0.90, 0.82 + (s - 0.90) * 0.6).when(s >= 0.80, s - 0.02).otherwise(s)


def interpolate(score: Column, points: Column) -> Column:
    """Linear interpolation on an array of structs (x, y) sorted by x, flat outside."""
    start = F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("out"))

    def step(a: Column, p: Column) -> Column:
        here = F.when(a["x"].isNull() | (p["x"] == a["x"]), p["y"]).otherwise(a["y"] + (p["y"] - a["y"]) * (score - a["x"]) / (p["x"] - a["x"]))
        out = F.when(a["out"].isNotNull(), a["out"]).when(score <= p["x"], here)
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), out.alias("out"))

    return F.aggregate(points, start, step, lambda a: F.coalesce(a["out"], a["y"], score))


def risk_of_weight(weight: Column | str) -> Column:
    w = as_column(weight)
    return F.when(w == 5, "CRITICO").when(w == 4, "ALTO").when(w == 3, "MODERADO").when(w.isin(1, 2), "BAIXO").otherwise("SEGURO")


def ui_level_of_risk(risk: Column | str) -> Column:
    """Interface level of a risk name; unknown names are safe."""
    r = fold(risk)
    return F.when(r == "CRITICO", "critical").when(r == "ALTO", "high").when(r == "MODERADO", "moderate").when(r == "BAIXO", "low").otherwise("safe")


def ui_level_of_probability(p: Column | str, cuts: tuple[float, float, float, float] = (0.9, 0.7, 0.4, 0.2)) -> Column:
    """Interface level of a probability; another set of cuts in use is (.95, .85, .6)."""
    p = as_column(p)
    names = ("critical", "high", "moderate", "low")
    out = F.lit("safe" if len(cuts) == 4 else "low")
    for cut, name in reversed(list(zip(cuts, names, strict=False))):
        out = F.when(p >= cut, name).otherwise(out)
    return out


def shown_confidence(classification: Column | str, confidence: Column | str) -> Column:
    """Confidence for display: .99 for public texts of confidence 0, else kept within 0 and 1."""
    c = as_column(confidence)
    return F.when((fold(classification) == "PUBLICO") & (c == 0), 0.99).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def percent(c: Column | str) -> Column:
    return F.format_string("%.1f%%", as_column(c) * 100)


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap of two spans over their hull."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)) / hull).otherwise(F.lit(0.0))


def preview(text: Column | str, width: int = 100) -> Column:
    t = as_column(text)
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("..."))).otherwise(t)


def elapsed(seconds: Column) -> Column:
    """Human form of an age in seconds."""
    s = seconds.cast("long")
    return F.when(s < 60, "agora").when(s < 3600, F.format_string("%d min", F.floor(s / 60))).when(s < 86400, F.format_string("%d h", F.floor(s / 3600))).otherwise(F.format_string("%d d", F.floor(s / 86400)))
