"""Sharding by extendible hashing.

A directory of hash-prefix bits starts with one bucket of no bits. Only a bucket
over the byte limit splits, on one more bit, until every bucket fits; a shard is
such a bucket. Since bytes add up, one histogram over prefixes of enough bits
tells the sizes of all buckets of every depth, so splitting costs one aggregation
of the keys rather than one for each bit, and the directory is a table that is as
long as there are shards.

A bucket that holds one key only can't split. Its rows are parted by the power of two
of their size, and the bytes of a part are laid end to end, by the rows' places in
their task and the bytes of the tasks before (no
task gathers them). Where a row starts says to which overflow page of the bucket it
goes; the stretch of a page is the limit less the part's longest row, so none is over it. A
single row above the limit has a page of its own and is marked ``oversized``.

Each row goes with all its columns to its shard and page, and ``write_shards`` writes
the shards: a file holds many pages one after the other, a page stands in one file, and
``offsets`` tells file, first row and rows of each. So there are as many files as write tasks,
not as shards, and a shard is read by the row groups that hold it.

Defined results: null texts have no bytes; a null key is a key; equal rows stay
apart as rows; all columns, whatever their names, are kept in ``document``; an empty table gives an empty result. Keys are hashed as text, null
as empty text; keys of equal hash prefix share a bucket that can't split.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peneira.llm.common import materialize, shared_dir

LIMIT = 1 << 20
#: Hash bits: 15 hexadecimal digits of the key's MD5.
MAX_BITS = 60
#: Parts of a bucket that can't split: by the binary digits of a row's size.
PARTS = 64


def directory(sized: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """``leaf, depth``: the depth of the shard that each prefix of ``bits`` bits belongs to; and ``bits``.

    ``sized`` has ``h`` and ``bytes``.
    """
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    bits = min(MAX_BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 4))
    while True:
        leaves = sized.groupBy(F.shiftright("h", MAX_BITS - bits).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
        leaves = materialize(leaves, "leaves")
        splits = leaves.where((F.col("bytes") > limit) & (F.col("low") < F.col("high"))).limit(1).count()
        if not splits or bits == MAX_BITS:
            break
        bits = min(MAX_BITS, bits + 8)
    up = leaves.select("leaf", "bytes", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    up = up.withColumn("node", F.expr(f"shiftright(leaf, {bits} - depth)"))
    nodes = up.groupBy("depth", "node").agg(F.sum("bytes").alias("total"), F.min("low").alias("least"), F.max("high").alias("most"))
    over = nodes.where((F.col("total") > limit) & (F.col("least") < F.col("most"))).select("depth", "node")
    depths = up.join(over, ["depth", "node"]).groupBy("leaf").agg((F.max("depth") + 1).alias("depth"))
    return leaves.select("leaf").join(depths, "leaf", "left").select("leaf", F.coalesce("depth", F.lit(0)).alias("depth")), bits


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: ``key``, bytes, shard (``<depth>-<prefix bits>``), page (0 unless its bucket
    can't split), depth, prefix, oversized, and the row itself as ``document``."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, MAX_BITS // 4), 16, 10).cast("long")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), hashed.alias("h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))
    sized = materialize(rows.select("h", "bytes"), "sized")
    leaves, bits = directory(sized, limit)
    leaves = materialize(leaves, "depths")
    # a bucket is over the limit only if all its rows have one hash
    full = materialize(sized.groupBy("h").agg(F.sum("bytes").alias("total")).where(F.col("total") > limit).select("h"), "full")
    leaf = F.shiftright("h", MAX_BITS - bits)
    fits = rows.join(full, "h", "left_anti").withColumn("page", F.lit(0).cast("long"))
    out = fits.select("key", "bytes", "h", "document", "page")
    if full.limit(1).count():
        lone = materialize(rows.join(full, "h", "left_semi").withColumns({"task": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "lone")
        lone = lone.withColumn("part", F.when(F.col("bytes") > limit, PARTS - 1).otherwise(F.length(F.bin("bytes"))))
        counts = lone.groupBy("h", "part", "task").agg(F.sum(F.greatest("bytes", F.lit(1))).alias("n"), F.min(F.greatest("bytes", F.lit(1))).alias("least"), F.max(F.greatest("bytes", F.lit(1))).alias("most"))
        part = Window.partitionBy("h", "part")
        tasks = part.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.select("h", "part", "task", F.coalesce(F.sum("n").over(tasks), F.lit(0)).alias("before"), F.min("least").over(part).alias("least"), F.max("most").over(part).alias("most"))
        places = Window.partitionBy("h", "part", "task").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        numbered = lone.withColumn("place", F.coalesce(F.sum(F.greatest("bytes", F.lit(1))).over(places), F.lit(0))).join(before, ["h", "part", "task"])
        # rows of one size fill a page to the last that fits; rows above the limit start in stretches of their own
        even = F.floor(F.lit(limit) / F.col("most")) * F.col("most")
        stretch = F.greatest(F.when(F.col("least") == F.col("most"), even).otherwise(F.lit(limit) - F.col("most") + 1), F.lit(1))
        page = F.floor((F.col("before") + F.col("place")) / stretch) * PARTS + F.col("part")
        out = out.unionByName(numbered.select("key", "bytes", "h", "document", page.cast("long").alias("page")))
    placed = out.withColumn("leaf", leaf).join(leaves, "leaf").withColumn("prefix", F.expr(f"shiftright(leaf, {bits} - depth)"))
    label = F.concat(F.col("depth").cast("string"), F.lit("-"), F.when(F.col("depth") > 0, F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).otherwise(""))
    return placed.select(F.col("key").alias(key), "bytes", label.alias("shard"), "page", F.col("depth").cast("int").alias("depth"), "prefix", (F.col("bytes") > limit).alias("oversized"), "document")


def write_shards(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Writes the shards, in the order of shard and page within each file, and gives the written table.

    Without ``path``, the shards go to the folder that driver and executors share.
    """
    sharded = shard(docs, key, text, limit)
    path = path or f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    sharded.repartition("shard", "page").sortWithinPartitions("shard", "page").write.parquet(path)
    return docs.sparkSession.read.schema(sharded.schema).parquet(path)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """Of each written page: shard, page, file, first (its first row there, from 0), rows, bytes. Texts are not read."""
    place = F.col("_metadata.row_index")
    pages = spark.read.parquet(path).select("shard", "page", "bytes", F.col("_metadata.file_name").alias("file"), place.alias("at"))
    return pages.groupBy("shard", "page", "file").agg(F.min("at").alias("first"), F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))


def read_shard(spark: SparkSession, path: str, shard: str, page: int | None = None) -> DataFrame:
    """The documents of a shard, or of one page; other row groups are passed over by their bounds."""
    rows = spark.read.parquet(path).where(F.col("shard") == shard)
    return (rows if page is None else rows.where(F.col("page") == page)).select("document.*")


#: The same for ``documents`` in DuckDB, where no document is above the limit.
SQL = f"""
with s as (select doc_id, coalesce(strlen(text), 0) as bytes, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h from documents),
n as (select d, h >> (60 - d) as node, sum(bytes) as total, min(h) as low, max(h) as high from s, (select unnest(range(0, 61)) as d) group by d, h >> (60 - d)),
o as (select d, node from n where total > {LIMIT} and low < high),
p as (select doc_id, bytes, h, coalesce(max(o.d) + 1, 0) as depth from s left join o on (h >> (60 - o.d)) = o.node group by doc_id, bytes, h)
select doc_id, bytes::bigint as bytes, depth::int as depth, h >> (60 - depth) as prefix, 0::bigint as page, false as oversized,
 depth || '-' || case when depth > 0 then lpad(ltrim(to_binary(h >> (60 - depth)), '') , depth::int, '0') else '' end as shard from p
"""
