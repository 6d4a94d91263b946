"""Session metrics, histograms, rankings, pages of results, and evaluation against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_metrics(analyses: DataFrame) -> DataFrame:
    """One row over has_pii and confianca of documents: totals by class and the mean confidence."""
    return analyses.agg(F.count("*").alias("total"), F.count_if(~F.col("has_pii")).alias("publicos"), F.count_if("has_pii").alias("nao_publicos"), F.round(F.avg("confianca"), 6).alias("confianca_media"))


def risk_histogram(documents: DataFrame) -> DataFrame:
    """Documents by risk with their share in percent; levels without documents don't show."""
    counts = documents.groupBy("risco").agg(F.count("*").alias("n"))
    total = documents.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("risco", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percentual"))


def top_types(findings: DataFrame, n: int = 7) -> DataFrame:
    """The most frequent kinds, by name among equals; a null kind counts as UNKNOWN."""
    kind = F.upper(F.coalesce("tipo", F.lit("UNKNOWN")))
    return findings.groupBy(kind.alias("tipo")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tipo").limit(n)


def top_accuracy(counters: DataFrame, n: int = 5) -> DataFrame:
    """The kinds with most feedback and their accuracy."""
    share = F.round(F.try_divide(F.col("corretos").cast("double"), F.col("total").cast("double")), 6)
    return counters.where("tipo is not null").select("tipo", "total", share.alias("acuracia")).orderBy(F.col("total").desc(), "tipo").limit(n)


def page(rows: DataFrame, number: int, order: list, size: int = 10) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def history(analyses: DataFrame, most: int = 10_000) -> DataFrame:
    """The newest analyses."""
    return analyses.orderBy(F.col("ts").desc(), "id").limit(most)


def confusion(judged: DataFrame, by: str | None = None) -> DataFrame:
    """tp, tn, fp, fn and what follows from them, of boolean previsto and esperado."""
    p, e = F.col("previsto"), F.col("esperado")
    counts = [F.count_if(p & e).alias("tp"), F.count_if(~p & ~e).alias("tn"), F.count_if(p & ~e).alias("fp"), F.count_if(~p & e).alias("fn")]
    agg = judged.groupBy(by).agg(*counts) if by else judged.agg(*counts)
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return agg.withColumns({"precisao": ratio(tp, tp + fp), "revocacao": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "acuracia": ratio(tp + tn, tp + tn + fp + fn)})


def confidence_statistics(findings: DataFrame, high: float = 0.9, low: float = 0.7) -> DataFrame:
    """Mean, upper median, and counts above and below two limits, of the values as they are.

    The value at position n div 2 lies in one of a thousand classes, which their counts
    tell; only the distinct values of that class are put in order.
    """
    value = F.col("confianca")
    step = F.floor(value.cast("double") * 1000)
    per = findings.where(value.isNotNull()).groupBy(step.alias("step"), value.alias("confianca")).agg(F.count("*").alias("n"))
    counts = per.groupBy("step").agg(F.sum("n").alias("n"), F.sum(F.when(value >= high, F.col("n")).otherwise(0)).alias("acima"), F.sum(F.when(value < low, F.col("n")).otherwise(0)).alias("abaixo"), F.sum(value * F.col("n")).alias("soma"))
    upto = F.sum("n").over(Window.orderBy("step"))
    whole = Window.partitionBy()
    placed = counts.withColumns({"upto": upto, "half": F.floor(F.sum("n").over(whole) / 2), "media": F.round(F.sum("soma").over(whole) / F.sum("n").over(whole), 6), "acima": F.sum("acima").over(whole), "abaixo": F.sum("abaixo").over(whole)})
    at = placed.where((F.col("upto") > F.col("half")) & (F.col("upto") - F.col("n") <= F.col("half"))).select("step", (F.col("upto") - F.col("n")).alias("before"), "half", "media", "acima", "abaixo")
    within = per.join(F.broadcast(at), "step")
    ranked = within.withColumn("_upto", F.sum("n").over(Window.partitionBy("step").orderBy("confianca")) + F.col("before"))
    return ranked.where(F.col("_upto") > F.col("half")).groupBy("media", "acima", "abaixo").agg(F.min("confianca").alias("mediana")).select("media", "mediana", "acima", "abaixo")


def batch_totals(rows: DataFrame, text: str = "text", least: int = 10) -> DataFrame:
    """One row: the rows of a batch, and how many have a text that is long enough to be analysed."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) >= least).alias("validos"))
