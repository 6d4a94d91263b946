"""Terms of a table of any size in texts, by an index on each term's rarest word.

A term occurs where its words stand one after the other, case, accents and what parts the words
aside. The index has each term under that of its words which the fewest terms hold. A text's words
are looked up there with the few that stand around them; which windows to cut is told by the shapes
(place of the word, number of words) that terms of that word have, so work grows with the texts and
not with the terms that share a word. Nothing is looked for by literals in the plan.

Null and wordless texts hold nothing, null and wordless terms are nowhere; terms of the same words
are all found. Texts may repeat their keys: each text's occurrences are rows of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peneira.functions.normalize import fold, let

WORD = r"[\p{L}\p{N}]+"
#: Bytes of an index up to which it is sent to all tasks; a greater one is shuffled with the words.
MOST_SENT = 64 << 20
#: Parts that rows of one value are spread over.
PARTS = 32


def words(text: Column | str) -> Column:
    """The words of a text, in upper case without accents."""
    return F.regexp_extract_all(fold(text), F.lit(f"({WORD})"), F.lit(1))


def index(terms: DataFrame, term: str = "termo") -> DataFrame:
    """termo, norma (its words), n (how many), palavra (the rarest), antes (words before that)."""
    each = terms.select(F.col(term).alias("termo")).where(F.col(term).isNotNull()).distinct().withColumn("_w", words("termo")).where(F.size("_w") > 0)
    placed = each.select("termo", F.array_join("_w", " ").alias("norma"), F.size("_w").alias("n"), F.posexplode("_w").alias("antes", "palavra"))
    held = placed.groupBy("palavra").agg(F.count("*").alias("_held"))
    rank = F.struct("_held", -F.length("palavra"), "antes")
    return placed.join(held, "palavra").groupBy("termo", "norma", "n").agg(F.min_by(F.struct("palavra", "antes"), rank).alias("_r")).select("termo", "norma", "n", "_r.palavra", "_r.antes")


def find(texts: DataFrame, terms: DataFrame, key: Sequence[str] = ("doc_id",), text: str = "text", term: str = "termo", most_sent: int = MOST_SENT) -> DataFrame:
    """Every occurrence: the key's columns, ``termo``, and ``palavra``, the place of its first word."""
    table = index(terms, term)
    size = table.agg(F.coalesce(F.sum(F.octet_length("norma") + F.octet_length("termo") + F.octet_length("palavra") + 96), F.lit(0)), F.coalesce(F.max("antes"), F.lit(0)), F.coalesce(F.max(F.col("n") - F.col("antes")), F.lit(1))).first()
    sent, back, ahead = size[0] <= most_sent, size[1], size[2]
    hint = F.broadcast if sent else lambda df: df
    shapes = table.groupBy("palavra").agg(F.collect_set(F.struct("antes", "n")).alias("_shapes"))

    def around(w: Column) -> Column:
        # a slice is as long as the longest term, so a text's rows stay in proportion to it
        first = lambda i: F.greatest(i - back, F.lit(0))
        return F.transform(w, lambda x, i: F.struct(i.alias("at"), x.alias("palavra"), (i - first(i)).alias("before"), F.slice(w, first(i) + 1, i - first(i) + ahead).alias("near")))

    every = texts.select(*key, F.inline(let(words(text), around)))
    shaped = every.join(hint(shapes), "palavra").select(*key, "at", "before", "near", F.inline("_shapes"))
    fits = (F.col("antes") <= F.col("before")) & (F.col("before") - F.col("antes") + F.col("n") <= F.size("near"))
    norm = F.array_join(F.expr("slice(near, before - antes + 1, n)"), " ")
    cut = shaped.where(fits).select(*key, (F.col("at") - F.col("antes")).alias("_at"), "antes", norm.alias("norma"))
    return cut.join(hint(table.select("termo", "norma", "antes")), ["norma", "antes"]).select(*key, "termo", F.col("_at").alias("palavra"))


def without(rows: DataFrame, terms: DataFrame, value: str = "valor", only: Column | None = None, term: str = "termo", most_sent: int = MOST_SENT) -> DataFrame:
    """The rows whose value holds no term; of those that ``only`` doesn't hold for, all.

    Each value is looked at once. Rows of a value go to ``PARTS`` places, so a frequent one splits.
    """
    asked = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    values = rows.where(asked).select(F.col(value).alias("_v")).distinct()
    held = find(values, terms, ("_v",), "_v", term, most_sent).select("_v").distinct()
    spread = held.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    marked = rows.withColumns({"_v": F.when(asked, F.col(value)), "_part": F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)).cast("int")})
    return marked.join(spread, ["_v", "_part"], "left_anti").select(*rows.columns)
