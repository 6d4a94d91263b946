"""Removal of duplicates and fragments among a document's findings.

A finding goes if one that ranks before it contains it. Since containment is
transitive, that equals keeping the longest first and skipping what they contain, so
it is a left anti join on the document instead of a loop. All sides are partitioned
by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peneira.functions.validators import digits
from peneira.operators.vocabulary import NOT_NAMES


#: Stands between values; values don't hold it.
_SEP = "\x01"


def _drop_contained(rows: DataFrame, norm: Column, rank: list[Column]) -> DataFrame:
    marked = rows.withColumns({"_norm": norm, "_rank": F.struct(*(c.alias(f"r{i}") for i, c in enumerate(rank)))})
    a, b = marked.alias("a"), marked.select("doc_id", "_norm", "_rank").alias("b")
    # ranks are greater the earlier they come
    earlier = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b._rank") > F.col("a._rank")) & F.contains(F.col("b._norm"), F.col("a._norm"))
    return a.join(b, earlier, "left_anti").drop("_norm", "_rank")


def dedup_names(rows: DataFrame) -> DataFrame:
    """Drops names with a word that is none, short ones, and parts of longer ones."""
    low = F.trim(F.lower("valor"))
    words = F.size(F.filter(F.split(F.trim("valor"), r"\s+"), lambda w: F.length(w) > 1))
    bad = F.arrays_overlap(F.split(low, r"\s+"), F.array(*(F.lit(w) for w in NOT_NAMES)))
    long_enough = F.when(F.col("source") == "gatilho", (words >= 1) & (F.length(F.trim("valor")) >= 4)).otherwise(words >= 2)
    norm = F.regexp_replace(low, r"\s+", " ")
    return _drop_contained(rows.where(~bad & long_enough), norm, [F.length(norm), F.col("peso"), -F.col("seq")])


def dedup_phones(rows: DataFrame) -> DataFrame:
    """Drops numbers under four digits and fragments of longer ones."""
    d = digits("valor")
    return _drop_contained(rows.where(F.length(d) >= 4), d, [F.length(d), F.col("peso"), -F.col("seq")])


def dedup_addresses(rows: DataFrame) -> DataFrame:
    norm = F.trim(F.lower("valor"))
    return _drop_contained(rows, norm, [F.length("valor"), -F.col("seq")])


def dedup_exact(rows: DataFrame) -> DataFrame:
    """Of equal values of a kind the one of most weight, the first among equals."""
    spot = Window.partitionBy("doc_id", "tipo", F.trim(F.lower("valor"))).orderBy(F.col("peso").desc(), "seq")
    return rows.withColumn("_n", F.row_number().over(spot)).where("_n = 1 and trim(valor) <> ''").drop("_n")


def dedup(rows: DataFrame) -> DataFrame:
    """Each kind by its own rule, in one pass over each document's findings.

    Equals the rules above. A document's findings of a kind are gathered into one row, which
    its text bounds; a value that one of them contains is found by searching for it in all of
    them laid end to end, so no pairs are made.
    """
    columns = rows.columns
    kind, low = F.col("tipo"), F.trim(F.lower("valor"))
    family = F.when(F.contains(kind, F.lit("NOME")), "NOME").when(kind.isin("TELEFONE", "CELULAR"), "TELEFONE").when(kind == "ENDERECO_RESIDENCIAL", "ENDERECO").otherwise(kind)
    name = F.regexp_replace(low, r"\s+", " ")
    norm = F.when(family == "NOME", name).when(family == "TELEFONE", digits("valor")).otherwise(low)
    words = F.size(F.filter(F.split(F.trim("valor"), r"\s+"), lambda w: F.length(w) > 1))
    named = ~F.arrays_overlap(F.split(low, r"\s+"), F.array(*(F.lit(w) for w in NOT_NAMES))) & F.when(F.col("source") == "gatilho", (words >= 1) & (F.length(F.trim("valor")) >= 4)).otherwise(words >= 2)
    fit = F.when(family == "NOME", named).when(family == "TELEFONE", F.length(norm) >= 4).otherwise(low != "")
    size = F.when(family == "ENDERECO", F.length("valor")).when(family.isin("NOME", "TELEFONE"), F.length(norm)).otherwise(0)
    weight = F.when(family == "ENDERECO", 0).otherwise(F.col("peso"))
    rank = F.struct(size.alias("size"), weight.alias("weight"), (-F.col("seq")).alias("first"))
    # of equal values the first by rank stays; the parts of others are told by a search
    joined = _SEP + _SEP
    norm = F.translate(norm, _SEP, " ")
    marked = rows.withColumns({"_family": family, "_norm": norm, "_rank": rank}).where(fit)
    best = Window.partitionBy("doc_id", "_family", "_norm").orderBy(F.col("_rank").desc())
    firsts = marked.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    held = F.sort_array(F.collect_list(F.struct("_rank", *[c for c in firsts.columns if c not in ("doc_id", "_family", "_rank")])), asc=False)
    every = firsts.groupBy("doc_id", "_family").agg(held.alias("f"))
    every = every.withColumn("_all", F.concat(F.lit(_SEP), F.array_join(F.transform("f", lambda x: x["_norm"]), joined), F.lit(_SEP)))
    # a value's own place is where it stands between marks; what contains it and ranks before it stands earlier
    alone = lambda a: F.instr(F.col("_all"), a["_norm"]) > F.instr(F.col("_all"), F.concat(F.lit(_SEP), a["_norm"], F.lit(_SEP)))
    kept = F.when(F.col("_family").isin("NOME", "TELEFONE", "ENDERECO"), F.filter("f", alone)).otherwise(F.col("f"))
    return every.select("doc_id", F.inline(kept)).select(*columns)
