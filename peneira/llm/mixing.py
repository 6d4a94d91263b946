"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. ``source_targets`` turns weights into a target of words for each source:
   shares by weight, at most ``most_repeats`` times the source's size, the excess
   shared again by weight until nobody is above.
2. Documents are dealt to shards of about ``shard_words`` words (more if there are
   many sources) by a seeded hash.
   In a shard, each source has its share of its target. The shard's blocks of
   ``block_words`` words go to its sources by the highest quotients
   target / (2 k + 1): integer quotas for each shard.
3. In a shard, a source's documents stand in a seeded order, ``most_repeats``
   times over; that ring of words is cut into blocks of equal size. A seeded
   bijection of the block numbers chooses as many as the quota says, those of a
   full pass before those that only repeat. A document's words are what the
   chosen blocks cover of it.

Rows that are equal have one hash; where there are many of them, they are numbered (by
their place in their task and the counts of the tasks before) and dealt by that too,
so that no shard has to take them all. Every window is over one shard, so a source with a third of all rows is spread as
evenly as the rest. The table of sources (one row each) is the only thing that is
handled as a whole; it reaches the documents by a join whose side Spark sizes.

Defined results: a null or empty text has size 0 and takes nothing; null sources
are one source, after all others; equal rows are taken apart from each other by
their place in the shard only, and each counts; other columns, whatever their names,
take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peneira.llm.common import materialize, n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
SHARD_WORDS = 1 << 16
BLOCK_WORDS = 64
#: Rows of one hash from which on they are told apart by their number.
EQUAL_ROWS = 1000
#: Words of a shard for each source, at least.
CELL_WORDS = 2048
MICRO = 1_000_000
#: Primes above any number of blocks in a shard, steps of the bijections.
STEPS = (1_000_003, 1_299_709, 1_500_007, 1_999_993)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, take the ``weights`` in turn. Capping the
    least size-to-weight ratios first is where resharing ends, so one pass over
    the ordered sources finds the level of the others.
    """
    listed = F.array(*(F.lit(int(w)) for w in weights))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(most_repeats)
    ordered = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    left = F.lit(float(share)) * total - F.coalesce(F.sum(cap).over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    capped = named.withColumn("fits", level * F.col("weight") <= cap).withColumn("level", level)
    # the first source that fits sets the level of all that follow; the levels after it only fall
    first = F.max(F.when(F.col("fits"), F.col("level"))).over(Window.partitionBy())
    target = F.least(cap.cast("double"), F.coalesce(first * F.col("weight"), cap.cast("double")))
    return capped.select("source", "source_size", "weight", target.cast("double").alias("target"))


def quotas(cells: DataFrame, block_words: int, most_repeats: int) -> DataFrame:
    """Adds ``quota`` to rows ``shard, source, words, aim``: seats of the shard by highest quotients.

    ``aim`` is in millionths of a word, a whole number, so that sums don't depend on order.
    A shard has as many seats as its aims fill; a source has no more than its ring
    has blocks, of which the last may be short. Only the seats that rounding can move are ranked: a shard of
    S sources moves at most (S + 1) / 2 seats in sum.
    """
    shard = Window.partitionBy("shard")
    block_words = block_words * MICRO
    seats = F.round(F.sum("aim").over(shard) / block_words).cast("long")
    slack = (F.count("*").over(shard) + 1) * block_words / (2 * F.greatest(F.sum("aim").over(shard), F.lit(1)))
    exact = F.col("aim") / block_words
    blocks = F.ceil(F.col("words") * (most_repeats * MICRO) / block_words).cast("long")
    low = F.least(F.greatest(F.floor(exact * (1 - F.least(F.col("slack"), F.lit(1.0))) - 1), F.lit(0)).cast("long"), F.col("blocks"))
    high = F.least(F.ceil(exact * (1 + F.least(F.col("slack"), F.lit(1.0))) + 1).cast("long"), F.col("blocks"))
    sized = cells.withColumns({"seats": seats, "slack": slack, "blocks": blocks}).withColumns({"low": low, "high": high})
    contested = sized.withColumn("k", F.explode_outer(F.expr("case when high > low then sequence(low, high - 1) end")))
    contested = contested.withColumn("lows", F.sum(F.when(F.coalesce("k", "low") == F.col("low"), F.col("low")).otherwise(0)).over(shard))
    by_quotient = Window.partitionBy("shard").orderBy((F.col("aim") / (2 * F.col("k") + 1)).desc_nulls_last(), F.col("source").asc_nulls_last(), "k")
    won = F.col("k").isNotNull() & (F.row_number().over(by_quotient) <= F.col("seats") - F.col("lows"))
    ranked = contested.withColumn("won", won.cast("long"))
    return ranked.groupBy("shard", "source", "words", "blocks").agg((F.first("low") + F.sum("won")).alias("quota"))


def spread_equals(sized: DataFrame, most: int = EQUAL_ROWS) -> DataFrame:
    """``sized`` with a ``draw`` of its own for each of over ``most`` rows that share one.

    Which of the equal rows gets which draw may differ between runs, but not what draws there are.
    """
    hot = materialize(sized.groupBy("draw").agg(F.count("*").alias("n")).where(F.col("n") > most).select("draw"), "hot")
    if not hot.limit(1).count():
        return sized
    lone = materialize(sized.join(hot, "draw", "left_semi").withColumns({"task": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "lone")
    tasks = Window.partitionBy("draw").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = lone.groupBy("draw", "task").agg(F.count("*").alias("rows")).select("draw", "task", F.coalesce(F.sum("rows").over(tasks), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("draw", "task").orderBy("row"))
    numbered = lone.withColumn("place", place).join(before, ["draw", "task"]).withColumn("draw", F.xxhash64("draw", F.col("place") + F.col("before")))
    return sized.join(hot, "draw", "left_anti").select(*sized.columns).unionByName(numbered.select(*sized.columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_repeats: int = MOST_REPEATS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, shard, ``mark`` (a hash of the text), ``taken``, the words that the mix takes,
    and ``spans``, where the chosen blocks cover the document: a ``first`` word and the one after the ``last``, from 0, for each block and pass."""
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text", F.lit(seed)).alias("draw"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")), "sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_repeats)
    total = sized.agg(F.sum("size")).first()[0] or 0
    # rounding to blocks weighs little only if a source has many words in a shard
    shard_words = max(shard_words, CELL_WORDS * sources.count())
    shards = max(1, -(-int(total) // shard_words))
    dealt = spread_equals(sized).withColumn("shard", F.pmod("draw", F.lit(shards)))
    with_target = dealt.join(sources, dealt["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    cells = with_target.groupBy("shard", "source").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    cells = cells.withColumn("aim", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("words") / F.col("source_size") * MICRO)).otherwise(0).cast("long"))
    quota = quotas(cells.select("shard", "source", "words", "aim"), block_words, most_repeats)
    # null sources as a value, so that both sides keep one partitioning
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("cell")
    placed = with_target.select("*", key)
    spot = Window.partitionBy("shard", "cell").orderBy("draw", "doc_id", "size")
    placed = placed.withColumn("start", F.sum("size").over(spot.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = placed.join(quota.select("shard", key, "words", "blocks", "quota"), ["shard", "cell"])
    step = F.element_at(F.array(*(F.lit(x) for x in STEPS)), (F.pmod(F.xxhash64("shard", "cell", F.lit(seed)), F.lit(len(STEPS))) + 1).cast("int")).cast("long")
    turn = F.pmod(F.xxhash64("cell", "shard", F.lit(seed)), F.greatest("blocks", F.lit(1)))
    passes = F.ceil(F.col("words") / block_words).cast("long")
    b, size, begin = F.lit(block_words), F.col("size"), F.col("start")

    def chosen(block: Column, first: Column, count: Column, taken: Column) -> Column:
        """Whether ``block`` is among ``taken`` of the ``count`` blocks from ``first`` on."""
        return F.pmod((block - first) * F.col("step") + F.col("turn"), count) < taken

    def covered(turn_no: int) -> Column:
        low, high = begin + F.col("words") * turn_no, begin + size + F.col("words") * turn_no
        blocks = F.sequence(F.floor(low / b), F.floor((high - 1) / b))
        early = F.least("firsts", "blocks")

        def is_taken(block: Column) -> Column:
            taken = F.when(block >= F.col("blocks"), F.lit(False)).when(block < early, chosen(block, F.lit(0), F.greatest(early, F.lit(1)), F.least("quota", early)))
            return taken.otherwise(chosen(block, early, F.greatest(F.col("blocks") - early, F.lit(1)), F.col("quota") - early))

        def span(block: Column) -> Column:
            return F.struct((F.greatest(low, block * b) - low).cast("long").alias("first"), (F.least(high, (block + 1) * b) - low).cast("long").alias("last"))

        return F.when(size > 0, F.transform(F.filter(blocks, is_taken), span)).otherwise(F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)"))

    placed = placed.withColumns({"step": step, "turn": turn, "firsts": passes})
    placed = placed.withColumn("spans", F.concat(*(covered(i) for i in range(most_repeats))))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["last"] - x["first"])
    return placed.select("doc_id", "size", "source", "source_size", "target", "shard", "mark", taken.cast("long").alias("taken"), "spans")


def whole_copies(mixed: DataFrame, seed: int = 17) -> DataFrame:
    """Adds ``copies``, so that whole documents come near the words that the mix takes.

    In each shard and source, the shares taken of the documents are summed from the
    shortest to the longest document, and a document has as many copies as whole
    numbers are passed at it, counted from a seeded start: documents of about equal
    length make up for each other. At most one more copy than the share is made.
    """
    cell = Window.partitionBy("shard", "source")
    order = cell.orderBy("size", "doc_id", "mark")
    start = F.pmod(F.xxhash64("shard", "source", F.lit(seed)), F.lit(MICRO))
    share = F.when(F.col("size") > 0, F.round(F.col("taken") * MICRO / F.col("size")).cast("long")).otherwise(0)
    upto = F.sum(share).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + start
    return mixed.withColumn("copies", (F.floor(upto / MICRO) - F.floor((upto - share) / MICRO)).cast("int"))
