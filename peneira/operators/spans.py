"""Overlapping spans: islands, post-processing, preference merge, evaluation, containment."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peneira.functions.normalize import let


def islands(spans: DataFrame, touching: bool = False, start: str = "s", end: str = "e") -> DataFrame:
    """Adds ``island``, the number of each group of overlapping (or touching) spans of a document.

    A span opens an island if it starts at or after the greatest end before it.
    """
    order = Window.partitionBy("doc_id").orderBy(start, "seq")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | ((F.col(start) > reach) if touching else (F.col(start) >= reach))
    return spans.withColumn("_opens", opens.cast("int")).withColumn("island", F.sum("_opens").over(order)).drop("_opens")


def merge_overlaps(spans: DataFrame) -> DataFrame:
    """One row per island: its span, its sources and the best score of each."""
    per_source = islands(spans).groupBy("doc_id", "island", "fonte").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max("score").alias("score"), F.count("*").alias("n"))
    return per_source.groupBy("doc_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("fonte", "score")))).alias("scores"))


def post_process(spans: DataFrame, min_len: int = 2, merge: bool = True, split_on: str | Callable[[int, int, str], list[tuple[int, int]]] | None = None) -> DataFrame:
    """doc_id, s, e: drops short spans, joins touching ones, and puts the parts that ``split_on`` finds in their place.

    ``split_on`` is an expression whose matches in the span's own text are the parts, or
    a function of (s, e, that text) that gives them as spans of the document. A span without parts stays.
    It needs the document's text in column ``text``.
    """
    spans = spans.where(F.col("e") - F.col("s") >= min_len)
    body = [F.first("text").alias("text")] if split_on is not None else []
    if merge:
        spans = islands(spans, touching=True).groupBy("doc_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), *body).drop("island")
    if split_on is None:
        return spans.select("doc_id", "s", "e")
    own = spans.select("doc_id", "s", "e", F.expr("substring(text, s + 1, e - s)").alias("text"))
    if callable(split_on):

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(d, *part) for d, s, e, t in zip(pdf.doc_id, pdf.s, pdf.e, pdf.text, strict=True) for part in split_on(s, e, t) or [(s, e)]]
                yield pd.DataFrame(rows, columns=["doc_id", "s", "e"])

        return own.mapInPandas(cut, own.select("doc_id", "s", "e").schema)
    found = F.regexp_extract_all("text", F.lit(split_on), F.lit(0))
    gaps = F.transform(F.split("text", split_on, -1), lambda x: F.length(x))
    # the n-th part starts after the gaps and parts before it
    before = lambda i: F.aggregate(F.slice(F.col("gaps"), 1, i + 1), F.col("s"), lambda a, x: a + x) + F.aggregate(F.slice(F.col("found"), 1, i), F.lit(0), lambda a, x: a + F.length(x))
    parts = F.transform("found", lambda x, i: F.struct(before(i).cast("int").alias("s"), (before(i) + F.length(x)).cast("int").alias("e")))
    whole = F.array(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))
    split = own.withColumns({"found": found, "gaps": gaps})
    return split.select("doc_id", F.inline(F.when(F.size("found") > 0, parts).otherwise(whole)))


def _groups(spans: DataFrame) -> DataFrame:
    """Each span with ``group``, its number ``i`` in the order s, longest first, seq, and its island.

    The first span of an island leads a group of those that overlap it; the next that doesn't leads the next.
    What overlaps a leader stands behind it without gaps (but for empty spans at its start, which are
    groups of their own), so a fold that remembers the last leader tells the groups. Islands never
    share a group, so the fold is as long as an island, not as a document.
    """
    columns = F.struct(F.col("s"), (-F.col("e")).alias("_e"), F.col("seq"), F.struct(*spans.columns).alias("row"))
    held = islands(spans).groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(columns)).alias("held"))
    start = F.expr("named_struct('s', -1, 'e', -1, 'at', -1, 'out', cast(array() as array<int>))")

    def step(acc, x):
        s, e = x["row"]["s"].cast("int"), x["row"]["e"].cast("int")
        mine = (s < acc["e"]) & (e > acc["s"])
        leads, here = ~mine & (e > s), F.size(acc["out"])
        number = F.when(mine, acc["at"]).otherwise(here)
        return F.struct(F.when(leads, s).otherwise(acc["s"]).alias("s"), F.when(leads, e).otherwise(acc["e"]).alias("e"), F.when(leads, here).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], F.array(number)).alias("out"))

    numbers = F.aggregate("held", start, step, lambda acc: acc["out"])
    placed = held.select("doc_id", "island", "held", numbers.alias("numbers"))
    return placed.select("doc_id", "island", F.posexplode(F.arrays_zip("held", "numbers")).alias("i", "z")).select("doc_id", "island", "i", F.col("z.numbers").alias("group"), F.col("z.held.row").alias("row"))


def prefer(spans: DataFrame, by: str = "longest", sources: Sequence[str] = (), choose: Callable[[list[dict]], dict] | None = None, order: str = "leftmost") -> DataFrame:
    """Of each leftmost span and what overlaps it, one: the longest, the best scored, the preferred source's, or ``choose``'s.

    Among equals the first by start, length and seq; null scores come last. A document's rows stand
    together, by ``order``: leftmost, rightmost, or in the order of the groups. Only ``custom`` leaves the JVM.
    """
    groups = _groups(spans)
    row, known = F.col("row"), F.lit(None).cast("int")
    for i, name in enumerate(sources):
        known = F.when(row["fonte"] == name, -i).otherwise(known) if i else F.when(row["fonte"] == name, 0)
    if by == "custom" and choose is not None:
        whole = groups.groupBy("doc_id", "island", "group").agg(F.sort_array(F.collect_list(F.struct("i", "row"))).alias("rows"))

        @F.udf(spans.schema)
        def chosen(rows) -> dict:
            some = [r["row"].asDict() for r in rows]
            return some[0] if len(some) == 1 else choose(some)

        best = whole.select("doc_id", "group", chosen("rows").alias("row"))
    else:
        worth = {"longest": (row["e"] - row["s"]).cast("double"), "score": row["score"].cast("double") if by == "score" else None, "source": F.coalesce(known, F.lit(-len(sources))).cast("double")}.get(by)
        rank = F.struct(F.coalesce(F.lit(0.0) if worth is None else worth, F.lit(float("-inf"))).alias("worth"), (-F.col("i")).alias("first"))
        best = groups.groupBy("doc_id", "island", "group").agg(F.max_by("row", rank).alias("row")).select("doc_id", "group", "row")
    rows = best.select("row.*", "group")
    sort = {"leftmost": ["s", "e"], "rightmost": [F.desc("e"), F.desc("s")]}.get(order, ["s", "group"])
    return rows.sortWithinPartitions("doc_id", *sort).select(*spans.columns)


def evaluate(predicted: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and mean_iou per document: each prediction in turn takes the best free truth.

    Pairs need an overlap above ``least`` (0 or more), so each island of predictions and truths is
    matched on its own, by a fold over its predictions in the order of seq.
    """
    if least < 0:
        raise ValueError("least must be 0 or more")
    side = lambda df, real: df.select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"), F.lit(real).alias("real"))
    every = islands(side(predicted, False).unionByName(side(truth, True)))
    span = F.struct("seq", "s", "e")
    own = lambda real: F.transform(F.sort_array(F.collect_list(F.when(F.col("real") == real, span))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    held = every.groupBy("doc_id", "island").agg(own(False).alias("p"), own(True).alias("t"))

    def share(p, t):
        hull = F.greatest(p["e"], t["e"]) - F.least(p["s"], t["s"])
        both = F.greatest(F.lit(0), F.least(p["e"], t["e"]) - F.greatest(p["s"], t["s"]))
        return F.when(hull > 0, both.cast("double") / hull).otherwise(0.0)

    def step(acc, p):
        def matched(v):
            best = F.array_max(v)
            at = F.array_position(v, best).cast("int")
            rest = F.concat(F.slice(acc["free"], F.lit(1), at - 1), F.slice(acc["free"], at + 1, F.size(acc["free"])))
            hit = F.struct(rest.alias("free"), F.concat(acc["hits"], F.array(best)).alias("hits"))
            return F.when(F.coalesce(best > least, F.lit(False)), hit).otherwise(acc)

        return let(F.transform(acc["free"], lambda t: share(p, t)), matched)

    start = F.struct(F.col("t").alias("free"), F.expr("cast(array() as array<double>)").alias("hits"))
    done = held.select("doc_id", F.size("p").alias("_p"), F.size("t").alias("_t"), F.aggregate("p", start, step, lambda acc: acc["hits"]).alias("hits"))
    total = done.groupBy("doc_id").agg(F.sum(F.size("hits")).cast("int").alias("tp"), F.sum("_p").cast("int").alias("_p"), F.sum("_t").cast("int").alias("_t"), F.sum(F.aggregate("hits", F.lit(0.0), lambda a, x: a + x)).alias("_iou"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    shares = total.withColumns({"_pr": ratio(F.col("tp"), F.col("_p")), "_re": ratio(F.col("tp"), F.col("_t"))})
    f1 = ratio(2 * F.col("_pr") * F.col("_re"), F.col("_pr") + F.col("_re"))
    return shares.select("doc_id", "tp", (F.col("_p") - F.col("tp")).alias("fp"), (F.col("_t") - F.col("tp")).alias("fn"), F.round("_pr", 4).alias("precision_spans"), F.round("_re", 4).alias("recall_spans"), F.round(f1, 4).alias("f1_spans"), F.round(ratio(F.col("_iou"), F.col("tp")), 4).alias("mean_iou"))


def not_contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Spans of ``inner`` that no span of ``outer`` of their document covers."""
    a, b = inner.alias("a"), outer.select("doc_id", "s", "e").alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.s") <= F.col("a.s")) & (F.col("a.e") <= F.col("b.e")), "left_anti")
