"""Hooks for name models and an arbiter; none is on by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = "doc_id long, tipo string, valor string, confianca double, peso int, inicio int, fim int, source string"
#: A model maps a text to (start, end, score) of person names.
Model = Callable[[str], list[tuple[int, int, float]]]


#: What a finding takes along of the text on either side.
NEAR = 160


def name_recognizer(load: Callable[[], Model], source: str, least: float = 0.0, most_chars: int | None = None, use_context: bool = True, may: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A plug-in from a function that loads a model; it is loaded once per task and gets whole texts unless ``most_chars`` says otherwise.

    ``may`` is an expression that any text with a name matches: others don't leave the JVM.
    Findings take a slice of the text along, so texts are not joined again.
    """
    from peneira.functions.confidence import context_factor
    from peneira.operators.names import immune, suppressed

    def recognize(docs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for pdf in batches:
                rows = []
                for i, t in zip(pdf.doc_id, pdf.text, strict=True):
                    for a, b, p in model((t or "")[:most_chars]):
                        if p >= least:
                            low = max(0, a - NEAR)
                            rows.append((i, "NOME", t[a:b].strip(), float(p), 4, a, b, source, t[low : b + NEAR], a - low))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in near.split(", ")])

        near = FOUND + ", near string, at int"
        some = docs.select("doc_id", "text").where("text is not null")
        found = (some if may is None else some.where(F.col("text").rlike(may))).mapInPandas(run, near)
        kept = found.where((F.length("valor") > 3) & F.contains("valor", F.lit(" ")) & ~suppressed(F.col("valor")) & ~immune(F.col("near"), F.col("at")))
        factor = context_factor(F.col("tipo"), F.col("near"), F.col("at"), F.col("at") + F.col("fim") - F.col("inicio")) if use_context else F.lit(1.0)
        return kept.withColumn("confianca", F.least(F.lit(1.0), F.col("confianca") * factor)).drop("near", "at")

    return recognize


def arbiter(keep: Callable[[str, str], bool]) -> Callable[[DataFrame], DataFrame]:
    """Keeps the pending findings for which ``keep(kind, value)`` holds; errors keep them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[_safe(keep, t, v) for t, v in zip(pdf.tipo, pdf.valor, strict=True)]]

    return lambda waiting: waiting.mapInPandas(run, waiting.schema)


def _safe(keep: Callable[[str, str], bool], kind: str, value: str) -> bool:
    try:
        return bool(keep(kind, value))
    except Exception:  # noqa: BLE001  an arbiter that fails must not lose findings
        return True


def complement(docs: DataFrame, everything: bool = False) -> DataFrame:
    """A plug-in for what the patterns leave: IBANs and, with ``everything``, cards whose check digits hold and addresses whose parts are bytes.

    The engine finds IBANs in its own pass; by default numbers and addresses are dropped with whatever
    consists of digits and points, so they are not looked for.
    """
    from peneira.operators.patterns import COMPLEMENT
    from peneira.operators.rules import judge

    found = judge(docs.select("doc_id", "text"), COMPLEMENT[1:] if everything else COMPLEMENT[:1])
    return found.select("doc_id", "tipo", "valor", "confianca", "peso", "inicio", "fim", F.lit("presidio").alias("source"))
