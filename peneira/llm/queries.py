"""The operators of this subpackage applied to whole tables, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from peneira.llm import clustering, quality_rules, sharding, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peneira.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).drop("spans")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peneira.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peneira.llm.suffix_dedup import digests

    return digests(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("mark", "host", "n_left", "removed_lines")


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peneira.llm.rule_ensemble import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.write_shards(_table(spark, sf_dir, "documents")).drop("document")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from peneira.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number ends its path; it is bad if that has quality 0."""
    from pyspark.sql import functions as F

    from peneira.llm import url_rules

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad"))
    shown = pages.select("url", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as bigint)").alias("doc_id"))
    return url_rules.judge(pages, shown.join(labels, "doc_id").select("url", "bad"), **url_rules.BY_LIFT)


def url_rules_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where URLs do tell: bad are, but for every 13th, the https pages of hosts under ``m`` or ``blog``, and every 11th of the others."""
    from pyspark.sql import functions as F

    from peneira.llm import url_rules

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    shady = F.col("url").rlike("^https://(m|blog)[.]")
    labelled = pages.select("url", F.when(shady, F.crc32("url") % 13 != 0).otherwise(F.crc32("url") % 11 == 0).alias("bad"))
    return url_rules.judge(pages, labelled, rules=(), **url_rules.BY_LIFT)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peneira.llm.ngram_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).drop("name", "mark")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(clustering.quantised(_table(spark, sf_dir, "embeddings")))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from peneira.llm import bpe

    return bpe.digests(bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from peneira.llm import whitening

    return whitening.whitened(whitening.quantised(_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_html_extraction": op2_html_extraction,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_rule_ensemble": op5_rule_ensemble,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_extendible_sharding": op7_extendible_sharding,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_url_rules": op9_url_rules,
    "url_rules_mined": url_rules_mined,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_bpe": op12_bpe,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality_rules.SQL,
    "op6_exact_top_k": topk.SQL,
    "op7_extendible_sharding": sharding.SQL,
    "op11_centroid_clustering": clustering.SQL,
}
