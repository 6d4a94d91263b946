"""Detection from texts to findings, documents and public results."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peneira.functions.confidence import risk_of_weight
from peneira.operators import dedup as D
from peneira.operators import explain as E
from peneira.operators import spans as S
from peneira.operators import terms as T
from peneira.operators import vote as V
from peneira.operators.names import heuristic_findings, trigger_findings
from peneira.operators.patterns import COMPLEMENT, PATTERNS, Pattern
from peneira.operators.rules import judge

#: Findings of models come as doc_id, tipo, valor, confianca, peso, inicio, fim, source.
Plugin = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Engine:
    """How to detect. Plug-ins (name models, an arbiter of pending findings) are off unless given."""

    patterns: Sequence[Pattern] = PATTERNS
    recognizers: Sequence[Plugin] = field(default_factory=tuple)
    #: Keeps some of the pending findings; without one all stay.
    arbiter: Plugin | None = None
    min_length: int = 10
    #: Of overlapping findings one stays: ``recall`` and ``f1`` keep the longest, ``precision`` the surest, ``custom`` what ``choose`` gives.
    merge_preset: str | None = None
    choose: Callable[[list[dict]], dict] | None = None
    #: IBANs (and, by ``plugins.complement``, cards and addresses) beside the patterns.
    complement: bool = True
    #: Terms (column ``termo``) that no name holds, of any number, for instance ``files.gazetteer``.
    gazetteer: DataFrame | None = None


FINDING = ("tipo", "valor", "confianca", "peso", "inicio", "fim", "source", "ord")
#: Place of the complement and of recognizers in the order that settles ties.
BESIDE = 3000


def candidates(docs: DataFrame, engine: Engine = Engine()) -> DataFrame:
    """All findings before voting, with ``seq`` in the order of sources, patterns and places, and ``contexto``.

    Patterns, heuristics, triggers and the complement look at a text in one pass; what they find is
    dealt out by document once, and all that follows keeps to that.
    """
    patterns = (*engine.patterns, *(COMPLEMENT[:1] if engine.complement else ()))
    found = judge(docs.select("doc_id", "text"), patterns, beside=lambda t: F.concat(heuristic_findings(t), trigger_findings(t)))
    made, iban = F.col("made"), F.col("name") == COMPLEMENT[0].name
    matched = {"source": F.when(iban, "presidio").otherwise("regex"), "ord": F.when(iban, BESIDE).otherwise(F.col("ord"))}
    every = found.select("doc_id", *(F.when(made.isNotNull(), made[c]).otherwise(matched.get(c, F.col(c))).alias(c) for c in FINDING), F.when(made.isNull() & ~iban, F.col("contexto")).alias("contexto"), F.coalesce(made["yields"], F.lit(False)).alias("yields"))
    for i, plugin in enumerate(engine.recognizers, 1 if engine.complement else 0):
        extra = plugin(docs).withColumns({"ord": F.lit(BESIDE + i), "yields": F.lit(False), "contexto": F.lit(None).cast("string")})
        every = every.unionByName(extra.select(*every.columns))
    if engine.gazetteer is not None:
        every = T.without(every, engine.gazetteer, only=F.contains("tipo", F.lit("NOME")))
    every = every.repartition("doc_id")
    # a heuristic yields to what else is found of its kind (a signature to the same name)
    same = Window.partitionBy("doc_id", "tipo", F.when(F.col("tipo") == "NOME", F.lower("valor")))
    firm = F.max(~F.col("yields")).over(same)
    kept = every.withColumn("_firm", firm).where(~(F.col("yields") & F.col("_firm"))).drop("yields", "_firm")
    return kept.withColumn("seq", F.col("ord").cast("long") * (1 << 32) + F.coalesce("inicio", F.lit(0)))


def merged(found: DataFrame, preset: str, choose: Callable[[list[dict]], dict] | None = None) -> DataFrame:
    """Of findings that overlap one, as the preset says."""
    by, order = {"recall": ("longest", "all"), "precision": ("score", "leftmost"), "f1": ("longest", "leftmost"), "custom": ("custom", "leftmost")}.get(preset, ("longest", "leftmost"))
    spans = found.withColumns({"s": F.col("inicio"), "e": F.col("fim"), "score": F.col("confianca"), "fonte": F.col("source")})
    return S.prefer(spans, by, choose=choose, order=order).select(*found.columns)


def findings(docs: DataFrame, engine: Engine = Engine()) -> DataFrame:
    """Findings after voting, removal of duplicates and thresholds, each with its explanation."""
    voted = V.vote(candidates(docs, engine))
    if engine.arbiter is not None:
        waiting = V.pending(voted)
        voted = voted.join(waiting.select("doc_id", "seq"), ["doc_id", "seq"], "left_anti").unionByName(engine.arbiter(waiting))
    kept = V.within_thresholds(D.dedup(voted))
    if engine.merge_preset is not None:
        kept = merged(kept, engine.merge_preset, engine.choose)
    return E.explained(kept, F.col("contexto")).drop("contexto", "ord")


def detect(docs: DataFrame, engine: Engine = Engine()) -> DataFrame:
    """Per document: doc_id, has_pii, risco, confianca and the public findings."""
    found = findings(docs, engine)
    public = F.struct("seq", "tipo", "valor", "confianca", "explicacao")
    rows = found.groupBy("doc_id").agg(F.max("peso").alias("peso"), F.max("confianca").alias("confianca"), F.min("confianca").alias("min_entity"), F.count("*").alias("total_entities"), F.sort_array(F.collect_set("source")).alias("sources_used"), F.transform(F.sort_array(F.collect_list(public)), lambda f: f.dropFields("seq")).alias("entities"))
    joined = docs.select("doc_id").join(rows, "doc_id", "left")
    has = F.col("peso").isNotNull()
    return joined.select(
        "doc_id",
        has.alias("has_pii"),
        F.when(has, risk_of_weight("peso")).otherwise("SEGURO").alias("risco"),
        F.coalesce("confianca", F.lit(1.0)).alias("confianca"),
        "min_entity",
        F.coalesce("total_entities", F.lit(0)).alias("total_entities"),
        F.coalesce("sources_used", F.expr("cast(array() as array<string>)")).alias("sources_used"),
        "entities",
    )


def detect_extended(docs: DataFrame, engine: Engine = Engine()) -> DataFrame:
    """``detect`` with the class and the three document confidences."""
    return detect(docs, engine).join(docs.select("doc_id", F.coalesce(F.trim("text"), F.lit("")).alias("_t")), "doc_id").select(
        "doc_id", "has_pii", "risco", "total_entities", "sources_used", "entities",
        F.when(F.col("has_pii"), "NÃO PÚBLICO").otherwise("PÚBLICO").alias("classificacao"),
        F.struct(
            F.when(F.col("has_pii"), F.lit(None)).when(F.col("_t") == "", 0.9999).otherwise(1 - F.col("confianca")).alias("no_pii"),
            F.when(F.col("has_pii"), F.col("confianca")).alias("all_found"),
            F.col("min_entity"),
        ).alias("confidence"),
    )


def analyze(docs: DataFrame, engine: Engine = Engine()) -> DataFrame:
    """The service's answer for each document; texts under the least length are not analysed."""
    short = docs.where(F.length(F.trim(F.coalesce("text", F.lit("")))) < engine.min_length)
    rest = docs.where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= engine.min_length)
    done = detect(rest, engine).select("doc_id", "has_pii", "risco", "confianca", "total_entities", "sources_used", F.when(F.col("has_pii"), "NÃO PÚBLICO").otherwise("PÚBLICO").alias("classificacao"), "entities", F.lit(True).alias("valid_for_stats"))
    none = short.select("doc_id", F.lit(False).alias("has_pii"), F.lit("BAIXO").alias("risco"), F.lit(1.0).alias("confianca"), F.lit(0).cast("long").alias("total_entities"), F.expr("cast(array() as array<string>)").alias("sources_used"), F.lit("PÚBLICO").alias("classificacao"), F.lit(None).cast(done.schema["entities"].dataType).alias("entities"), F.lit(False).alias("valid_for_stats"))
    return done.unionByName(none)
