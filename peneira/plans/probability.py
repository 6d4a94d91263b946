"""Probabilistic confidence: log-odds over sources, documents, and the raw pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.confidence import confidence_level, conservative, context_keywords, lookup
from peneira.functions.validators import check_confidence, valid_by_type
from peneira.operators.vocabulary import DEFAULT_FN, DEFAULT_FP, FN_RATE, FP_RATE, LGPD_WEIGHTS, PRIOR

LOW, HIGH, MOST_ODDS = 0.0001, 0.9999, 20.0


def _prior_odds(prior: float) -> Column:
    return F.log(F.lit(prior / (1 - prior)))


def evidence(source: Column, p: Column) -> Column:
    """Log of a source's clamped probability over its false-alarm rate."""
    return F.log(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), p)) / lookup(FP_RATE, source, DEFAULT_FP))


def from_log_odds(total: Column, prior: float = PRIOR) -> Column:
    odds = F.least(F.lit(MOST_ODDS), _prior_odds(prior) + total)
    return 1 / (1 + F.exp(-odds))


def combine(detections: DataFrame, by: list[str], source: str = "fonte", p: str = "p") -> DataFrame:
    """Combined probability of the positive detections of each group: a sum, so it pre-aggregates."""
    return detections.groupBy(*by).agg(from_log_odds(F.sum(evidence(F.col(source), F.col(p)))).alias("confianca"))


def no_pii(sources: DataFrame, by: list[str], source: str = "fonte") -> DataFrame:
    """Probability that a document has no personal data when none of its sources found any (Bayes)."""
    fn, fp = lookup(FN_RATE, F.col(source), DEFAULT_FN), lookup(FP_RATE, F.col(source), DEFAULT_FP)
    none, missed = F.exp(F.sum(F.log(1 - fp))) * (1 - PRIOR), F.exp(F.sum(F.log(fn))) * PRIOR
    return sources.groupBy(*by).agg(F.least(F.lit(0.9999999999), none / (none + missed)).alias("no_pii"))


def all_found(entities: DataFrame, by: list[str], p: str = "confianca", agreed: Column | None = None) -> DataFrame:
    """Confidence that all was found: mostly the least sure entity, a little more for sources that agree."""
    n = F.lit(1) if agreed is None else agreed
    mix = 0.7 * F.min(p) + 0.3 * F.avg(p)
    return entities.groupBy(*by).agg(F.least(F.lit(HIGH), mix * F.least(F.lit(1.1), 1 + 0.02 * (n - 1))).alias("all_found"), F.min(p).alias("min_entity"))


def entity_confidence(entities: DataFrame) -> DataFrame:
    """Needs tipo, valor, contexto, fontes array<struct<source, score>>; adds confianca, nivel, peso_lgpd, fontes_positivas, dv_valido.

    Unknown sources count as patterns; check digits are a source of their own.
    """
    kind, ok = F.upper("tipo"), valid_by_type(F.col("tipo"), F.col("valor"))
    known = lambda s: F.when(s.isin(*FP_RATE), s).otherwise(F.lit("regex"))
    base = F.aggregate(F.transform("fontes", lambda x: evidence(known(x["source"]), conservative(x["score"]))), F.lit(0.0), lambda a, b: a + b)
    digit = F.when(F.coalesce(ok, F.lit(False)), evidence(F.lit("dv_validation"), check_confidence(F.col("tipo"), F.col("valor")))).otherwise(0.0)
    combined = from_log_odds(base + digit) * context_keywords(F.col("contexto"), F.col("tipo"))
    sure = F.least(F.lit(HIGH), F.greatest(F.lit(LOW), combined))
    sources = F.concat(F.transform("fontes", lambda x: known(x["source"])), F.when(F.coalesce(ok, F.lit(False)), F.array(F.lit("dv_validation"))).otherwise(F.expr("cast(array() as array<string>)")))
    return entities.withColumns({"confianca": sure, "peso_lgpd": lookup(LGPD_WEIGHTS, kind, 3), "fontes_positivas": sources, "dv_valido": F.coalesce(ok, F.lit(False))}).withColumn("nivel", confidence_level("confianca"))


def raw_pipeline(detections: DataFrame) -> DataFrame:
    """Raw detections (doc_id, seq, tipo, valor, s, e, score, fonte) to entities by place, then to documents."""
    from peneira.operators.spans import islands

    placed = islands(detections)
    per = placed.groupBy("doc_id", "island", "fonte").agg(F.max("score").alias("score"), F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.struct(F.length("valor").alias("n"), (-F.col("seq")).alias("first"), "tipo", "valor")).alias("b"))
    merged = per.groupBy("doc_id", "island").agg(F.min("s").alias("inicio"), F.max("e").alias("fim"), F.max("b").alias("b"), F.sort_array(F.collect_list(F.struct(F.col("fonte").alias("source"), "score"))).alias("fontes"))
    return entity_confidence(merged.select("doc_id", "inicio", "fim", "b.tipo", "b.valor", "fontes", F.lit(None).cast("string").alias("contexto")))


def document_confidence(entities: DataFrame) -> DataFrame:
    """doc_id, all_found, min_entity, risco and the sources."""
    from peneira.functions.confidence import risk_of_weight

    flat = entities.select("doc_id", F.explode("fontes_positivas").alias("f")).groupBy("doc_id").agg(F.sort_array(F.collect_set("f")).alias("sources_used"))
    weights = entities.groupBy("doc_id").agg(risk_of_weight(F.max("peso_lgpd")).alias("risco"))
    return all_found(entities, ["doc_id"], agreed=F.floor(F.avg(F.size("fontes_positivas")))).join(weights, "doc_id").join(flat, "doc_id")
