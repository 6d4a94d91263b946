"""Voting over findings of one value, thresholds, and the document's risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.confidence import lookup, risk_of_weight
from peneira.operators.vocabulary import DOCUMENT_KINDS, SENSITIVE_KINDS, THRESHOLDS


def vote_reason(kind: Column, weight: Column, source: Column, sources: Column, confidence: Column) -> Column:
    """The first rule that speaks for a finding; without any it stays pending."""
    return (
        F.when(kind.isin(*DOCUMENT_KINDS), "documento_validado")
        .when(kind.isin(*SENSITIVE_KINDS), "dado_sensivel_lgpd")
        .when(weight >= 4, "peso_alto")
        .when(source == "gatilho", "gatilho_linguistico")
        .when(sources >= 2, F.format_string("votacao_%d_fontes", sources))
        .when(confidence >= 0.85, "alta_confianca")
        .when(confidence >= 0.70, "confianca_moderada_evitar_fn")
        .otherwise("baixa_confianca_pendente_llm")
    )


def vote(findings: DataFrame) -> DataFrame:
    """One finding per document and value (lower case, trimmed): the surest, the first by ``seq`` among equals.

    Needs doc_id, seq, valor, confianca, tipo, peso, source; other columns are carried.
    Adds votacao_motivo and the count of distinct sources. One shuffle, pre-aggregated.
    """
    others = [c for c in findings.columns if c != "doc_id"]
    keyed = findings.where("valor is not null").withColumn("_key", F.trim(F.lower("valor"))).where("_key <> ''")
    best = F.max_by(F.struct(*others), F.struct("confianca", (-F.col("seq")).alias("first")))
    voted = keyed.groupBy("doc_id", "_key").agg(best.alias("f"), F.size(F.collect_set("source")).cast("long").alias("n_fontes")).select("doc_id", "f.*", "n_fontes")
    reason = vote_reason(F.col("tipo"), F.col("peso"), F.col("source"), F.col("n_fontes"), F.col("confianca"))
    return voted.withColumn("votacao_motivo", reason)


def pending(voted: DataFrame) -> DataFrame:
    """Findings that no rule speaks for."""
    return voted.where("votacao_motivo = 'baixa_confianca_pendente_llm'")


def within_thresholds(findings: DataFrame) -> DataFrame:
    """Keeps findings near the weight and confidence limits of their kind; kinds without limits need a weight."""
    kind = F.col("tipo")
    weight = F.greatest(F.lit(1), lookup({k: w for k, (w, _) in THRESHOLDS.items()}, kind, 2) - 1)
    sure = lookup({k: round(c * 0.9, 6) for k, (_, c) in THRESHOLDS.items()}, kind, 0.0)
    listed = kind.isin(*THRESHOLDS)
    return findings.where(F.when(listed, (F.col("peso") >= weight) & (F.col("confianca") >= sure)).otherwise(F.col("peso") >= 1))


def document_risk(findings: DataFrame) -> DataFrame:
    """doc_id, risco, max_confianca, min_confianca, n_entidades, peso_max."""
    agg = findings.groupBy("doc_id").agg(F.max("peso").alias("peso_max"), F.max("confianca").alias("max_confianca"), F.min("confianca").alias("min_confianca"), F.count("*").alias("n_entidades"))
    return agg.withColumn("risco", risk_of_weight("peso_max"))


def ambiguous(findings: DataFrame) -> DataFrame:
    """doc_id, ambiguo: middling confidence, names only, or three or more findings below .75."""
    agg = findings.groupBy("doc_id").agg(F.max("confianca").alias("c"), F.min(F.col("tipo") == "NOME").alias("names"), F.count_if(F.col("confianca") < 0.75).alias("low"))
    return agg.select("doc_id", (((F.col("c") > 0.5) & (F.col("c") < 0.8)) | F.col("names") | (F.col("low") >= 3)).alias("ambiguo"))
