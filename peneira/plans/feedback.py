"""Human feedback: counts and rates, training data, calibration, and its status.

Feedback rows have tipo, fonte, confianca_modelo and validacao_humana (CORRETO,
INCORRETO or PARCIAL).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RIGHT, WRONG, PARTLY = "CORRETO", "INCORRETO", "PARCIAL"
LEAST_TOTAL, LEAST_SOURCE, READY = 10, 5, 50


def counters(feedback: DataFrame) -> DataFrame:
    """Right, wrong, partly and total by kind, with a row of null kind for all."""
    v = F.col("validacao_humana")
    return feedback.rollup("tipo").agg(F.count_if(v == RIGHT).alias("corretos"), F.count_if(v == WRONG).alias("incorretos"), F.count_if(v == PARTLY).alias("parciais"), F.count("*").alias("total"))


def rates(feedback: DataFrame) -> DataFrame:
    """Accuracy and false-positive rate by kind and for all (null kind), to four places."""
    ratio = lambda x: F.round(F.coalesce(F.try_divide(F.col(x).cast("double"), F.col("total").cast("double")), F.lit(0.0)), 4)
    return counters(feedback).select("tipo", "total", ratio("corretos").alias("acuracia"), ratio("incorretos").alias("taxa_fp"))


def latest(feedback: DataFrame, key: str = "valor", when: str = "ts") -> DataFrame:
    """The latest row of each value of a feedback record."""
    spot = Window.partitionBy("fb_id", key).orderBy(F.col(when).desc())
    return feedback.withColumn("_n", F.row_number().over(spot)).where("_n = 1").drop("_n")


def training_rows(feedback: DataFrame) -> DataFrame:
    """Score and label of each usable row: right is 1, wrong and partly are 0."""
    v = F.col("validacao_humana")
    label = F.when(v == RIGHT, 1).when(v.isin(WRONG, PARTLY), 0)
    return feedback.select("fonte", "tipo", F.col("confianca_modelo").alias("score"), label.alias("label")).where("label is not null and score is not null")


def training_summary(feedback: DataFrame) -> DataFrame:
    """Samples and positives by source."""
    return training_rows(feedback).groupBy("fonte").agg(F.count("*").alias("amostras"), F.sum("label").alias("positivos"))


def accuracy_at_half(rows: DataFrame) -> DataFrame:
    """Share of rows by source whose score tells their label at .5."""
    hit = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")
    return rows.groupBy("fonte").agg(F.round(F.avg(hit), 6).alias("acuracia"))


def bins(rows: DataFrame) -> DataFrame:
    """Average score and precision in ten bins of the score, by source."""
    b = F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int")
    return rows.groupBy("fonte", b.alias("faixa")).agg(F.avg(F.col("score").cast("double")).alias("score_medio"), F.avg(F.col("label").cast("double")).alias("precisao"), F.count("*").alias("n"))


#: A stretch of scores with one fitted value: first and last score, sum of labels, rows.
BLOCK = "fonte string, first double, last double, total long, count long"


def _pooled(blocks: list[list], more: Iterable[tuple]) -> list[list]:
    """``blocks`` with ``more`` behind them, neighbours that don't rise made one; whole numbers decide."""
    for first, last, total, count in more:
        blocks.append([first, last, int(total), int(count)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, total, count = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + total, blocks[-1][3] + count]
    return blocks


#: Training rows by source, kind and score: positives and rows.
COUNTS = "fonte string, tipo string, score double, total long, count long"


def score_counts(rows: DataFrame) -> DataFrame:
    """``COUNTS`` of training rows. Counts of batches add up, so they are what a calibration has to keep."""
    score, label = F.col("score").cast("double"), F.col("label").cast("long")
    tipo = F.col("tipo") if "tipo" in rows.columns else F.lit(None).cast("string")
    usable = rows.where(label.isNotNull() & score.isNotNull() & ~F.isnan(score))
    return usable.groupBy("fonte", tipo.alias("tipo"), (score + 0.0).alias("score")).agg(F.sum(label).alias("total"), F.count("*").alias("count"))


def isotonic_blocks(rows: DataFrame) -> DataFrame:
    """The blocks of the exact monotone fit of labels 0 and 1 to scores, by source: ``BLOCK``. Takes training rows or their ``score_counts``.

    Rows are added up by score, partitions of neighbouring scores are pooled on their own, and what
    they leave is pooled once more: pooling of pooled stretches is pooling of all rows. The values
    of blocks rise, and n rows of 0 and 1 have fewer than 2.1 n^(2/3) different rising means, so a
    source of 10^9 rows leaves a few million blocks at most, whatever its scores. Null scores or labels, and scores that
    are no number, take no part. Rows are not rounded or pooled by anything but their score.
    """
    import pandas as pd

    columns = [c.split()[0] for c in BLOCK.split(", ")]
    counts = rows if {"total", "count"} <= set(rows.columns) else score_counts(rows)
    points = counts.groupBy("fonte", F.col("score").alias("x")).agg(F.sum("total").alias("total"), F.sum("count").alias("count"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, blocks = None, []
        for pdf in batches:
            # a null source is one of its own
            for name, some in pdf.groupby(pdf.fonte.where(pdf.fonte.notna(), None), sort=False, dropna=False):
                name = None if pd.isna(name) else name
                if blocks and name != source:
                    yield pd.DataFrame([(source, *b) for b in blocks], columns=columns)
                    blocks = []
                source = name
                _pooled(blocks, zip(some.x, some.x, some.total, some["count"], strict=True))
        if blocks:
            yield pd.DataFrame([(source, *b) for b in blocks], columns=columns)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf.sort_values("first")
        blocks = _pooled([], zip(some["first"], some["last"], some.total, some["count"], strict=True))
        return pd.DataFrame([(pdf.fonte.iloc[0], *b) for b in blocks], columns=columns)

    near = points.repartitionByRange("fonte", "x").sortWithinPartitions("fonte", "x").mapInPandas(part, BLOCK)
    return near.groupBy("fonte").applyInPandas(whole, BLOCK)


def isotonic(rows: DataFrame) -> DataFrame:
    """Per source with enough rows, the points (x, y) of the exact monotone fit, y within .001 and .999: the ends of its blocks."""
    blocks = isotonic_blocks(rows)
    enough = blocks.withColumn("_n", F.sum("count").over(Window.partitionBy("fonte"))).where(F.col("_n") >= max(LEAST_SOURCE, LEAST_TOTAL))
    y = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("total") / F.col("count")))
    return enough.select("fonte", F.explode(F.array_distinct(F.array("first", "last"))).alias("x"), y.alias("y"))


def recalibrate(feedback: DataFrame, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The points of the fits, and a row of history for each source that was fitted.

    History: fonte, ts, amostras, accuracy at .5 before and after, the improvement, and
    ``por_tipo`` (of all sources). Under ``LEAST_TOTAL`` feedback rows nothing is fitted.
    """
    enough = feedback.limit(LEAST_TOTAL).count() == LEAST_TOTAL
    return recalibrate_counts(score_counts(training_rows(feedback)), at, enough)


def recalibrate_counts(counts: DataFrame, at: Column | None = None, enough: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """``recalibrate`` from ``score_counts``, for instance of a log of batches; ``LEAST_TOTAL`` is asked of the counts unless it is known."""
    if enough is None:
        enough = (counts.agg(F.sum("count")).first()[0] or 0) >= LEAST_TOTAL
    points = isotonic(counts if enough else counts.limit(0))
    tested = calibrated(counts.join(points.select("fonte").distinct(), "fonte", "left_semi"), points)
    hits = lambda c: F.sum(F.when(F.col(c) >= 0.5, F.col("total")).otherwise(F.col("count") - F.col("total"))).cast("double") / F.sum("count")
    per = tested.groupBy("fonte").agg(F.sum("count").alias("amostras"), F.round(hits("score"), 4).alias("acuracia_antes"), F.round(hits("calibrado"), 4).alias("acuracia_depois"))
    each = counts.groupBy(F.coalesce("tipo", F.lit("UNKNOWN")).alias("tipo")).agg(F.sum("count").alias("total"), F.sum("total").alias("corretos"))
    kinds = each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tipo", F.struct("total", "corretos"))))).alias("por_tipo"))
    history = per.join(F.broadcast(kinds)).withColumn("ts", F.current_timestamp() if at is None else at)
    return points, history.select("fonte", "ts", "amostras", "acuracia_antes", "acuracia_depois", F.round(F.col("acuracia_depois") - F.col("acuracia_antes"), 4).alias("melhora"), "por_tipo")


def by_type(rows: DataFrame) -> DataFrame:
    """Samples and right ones by kind over all sources; a null kind counts as UNKNOWN."""
    return rows.groupBy(F.coalesce("tipo", F.lit("UNKNOWN")).alias("tipo")).agg(F.count("*").alias("total"), F.sum("label").alias("corretos"))


#: Cells of scores that a curve is cut into, so that a row meets the few pieces of its own cell.
CELLS = 1024


def calibrated(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Scores through their source's fit, linear between points and flat outside; sources without one are calibrated conservatively.

    A null score stays null. A curve may have any number of points: its pieces are dealt to the cells of scores that they cross.
    """
    from peneira.functions.confidence import conservative

    by = Window.partitionBy("fonte").orderBy("x")
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    piece = lambda a, ay, b, by_: F.struct(a.alias("a"), ay.alias("ay"), b.alias("b"), by_.alias("by"))
    x, y = F.col("x"), F.col("y")
    onward = piece(x, y, F.coalesce("_x", high), F.coalesce("_y", y))
    ends = points.select("fonte", "x", "y", F.lead("x").over(by).alias("_x"), F.lead("y").over(by).alias("_y"), F.row_number().over(by).alias("_n"))
    pieces = ends.select("fonte", F.explode(F.when(F.col("_n") == 1, F.array(piece(low, y, x, y), onward)).otherwise(F.array(onward))).alias("p"))
    cell = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * CELLS).cast("int")
    cells = pieces.select("fonte", F.explode(F.sequence(cell(F.col("p.a")), cell(F.col("p.b")))).alias("_cell"), "p").groupBy("fonte", "_cell").agg(F.sort_array(F.collect_list("p")).alias("_pieces"))
    joined = rows.withColumn("_cell", cell(F.col("score").cast("double"))).join(cells, ["fonte", "_cell"], "left")
    score, own = F.col("score").cast("double"), F.col("_own")
    between = F.when(own["a"] == low, own["by"]).when(own["b"] == high, own["ay"]).otherwise(own["ay"] + (own["by"] - own["ay"]) * (score - own["a"]) / (own["b"] - own["a"]))
    found = joined.withColumn("_own", F.get(F.filter("_pieces", lambda p: score <= p["b"]), F.lit(0)))
    return found.withColumn("calibrado", F.when(own.isNotNull(), between).otherwise(conservative("score"))).select(*rows.columns, "calibrado")


def calibration_history(history: DataFrame) -> DataFrame:
    """By source: fits, samples, average improvement. Needs fonte, amostras, acuracia_antes, acuracia_depois."""
    return history.groupBy("fonte").agg(F.count("*").alias("calibracoes"), F.sum("amostras").alias("amostras"), F.avg(F.col("acuracia_depois") - F.col("acuracia_antes")).alias("melhora_media"))


def freshness(last: Column, now: Column) -> Column:
    """never, fresh (under an hour), recent (under a day) or stale."""
    age = now.cast("long") - last.cast("long")
    return F.when(last.isNull(), "never").when(age < 3600, "fresh").when(age < 86400, "recent").otherwise("stale")


def training_status(feedback: DataFrame) -> DataFrame:
    """One row: samples, accuracy, whether there is enough to train, and the advice."""
    rows = training_rows(feedback)
    agg = rows.agg(F.count("*").alias("amostras"), F.avg(F.col("label").cast("double")).alias("acuracia"))
    advice = (
        F.when(F.col("amostras") == 0, "coletar")
        .when(F.col("amostras") < 20, "coletar_mais")
        .when(F.col("amostras") < READY, "quase_pronto")
        .when(F.col("acuracia") < 0.85, "revisar")
        .when(F.col("acuracia") < 0.90, "ajustar")
        .otherwise("bom")
    )
    return agg.select("amostras", F.round("acuracia", 6).alias("acuracia"), (F.col("amostras") >= READY).alias("pronto"), advice.alias("recomendacao"))
