"""A corpus pipeline of five of the operators in ``peneira.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept; ``run`` writes each result as Parquet into the folder that the executors
share and reads it back for the next. All stages but the last return the columns
of ``documents``:

1. ``quality_rules`` drops the documents that the rules reject, and takes the lines
   that too many documents of a host have out of the others; n_chars is counted anew.
2. ``ngram_jaccard_join`` keeps one document of each group of near duplicates, the least
   by id (and by text hash where an id has several texts); its columns are the least of
   those of its equal rows.
3. ``suffix_dedup`` removes repeated 100-byte strings (see the operator) from the
   texts; a character that loses a byte goes whole, and n_chars is counted anew.
4. ``source_mixing`` repeats or drops whole documents so that each source comes near
   its target (``whole_copies``); copies keep their id.
5. ``best_fit_packing`` returns the pieces with their sequences and offsets.

A document is a pair of id and text: differing texts of one id, or of none, are documents
of their own. Rows without an id go by a hash of their text; the first three stages keep or
change all rows of equal text alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peneira.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from peneira.llm.common import discard, materialize, only

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _key(doc_id: str = "doc_id", text: str = "text"):
    """The id, or where there is none a hash of the text from 2**62 on."""
    return F.coalesce(F.col(doc_id).cast("long"), F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 2) + F.lit(1 << 62))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(docs.withColumn("key", _key()), doc_id="key")
    kept = judged.where("kept").select(F.col("doc_id").alias("key"), "mark", "host", "removed_lines").dropDuplicates(["key", "mark", "host"])
    marked = docs.withColumns({"key": _key(), "mark": F.xxhash64(F.coalesce("text", F.lit(""))), "host": quality_rules.host_key(F.col("source"))})
    joined = marked.join(kept, ["key", "mark", "host"])
    cut = F.size("removed_lines") > 0
    text = F.when(cut, quality_rules.without_lines(F.col("text"), F.col("removed_lines"))).otherwise(F.col("text"))
    joined = joined.withColumn("text", text)
    return joined.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.withColumn("key", _key())
    stays = ngram_join.near_duplicates(keyed, doc_id="key").where("name = class_id").select(F.col("doc_id").alias("key"), "mark").distinct()
    # equal rows become one before any is sent, however many they are
    rest = [c for c in COLUMNS if c != "text"]
    whole = keyed.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit("")))).groupBy("key", "mark").agg(F.min(F.struct(*rest)).alias("row"), F.min("text").alias("text"))
    return whole.join(stays, ["key", "mark"]).select("row.*", "text").select(*COLUMNS)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(docs, ["doc_id", "lang", "source"])
    return kept.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.whole_copies(mixing.mix(docs.withColumn("doc_id", _key())))
    copies = mixed.where("copies > 0").groupBy(F.col("doc_id").alias("key"), "mark").agg(F.max("copies").alias("copies"))
    marked = docs.withColumns({"key": _key(), "mark": F.xxhash64(F.coalesce("text", F.lit("")))})
    return marked.join(copies, ["key", "mark"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_dedup", suffixes),
    ("source_mixing", mixture),
    ("best_fit_packing", packed),
]

#: Hashes of shingles and suffixes decide; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        written = []
        # what the stage wrote for itself goes, and so does its input
        with only(written):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            written.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs
