"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset, a temporary folder
    serves, but only for a local master, whose tasks run on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="peneira-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Paths of the tables written by this process and not yet deleted.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    Lineage ends at the written table, so a lost executor costs at most the
    tasks after it, and what two consumers read is computed once.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    _WRITTEN.append(path)
    return table


@contextlib.contextmanager
def only(kept: list[DataFrame]):
    """Deletes, at its end, the tables written inside it but for those put into ``kept``."""
    before = set(_WRITTEN)
    yield
    if kept:
        stay = before | {t.written_at for t in kept}
        for path in [x for x in _WRITTEN if x not in stay]:
            _delete(kept[0].sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished jobs.

    Spark deletes them when the driver collects garbage; between the steps of one
    operator that would otherwise be long after. A crutch, for want of a call that
    frees a finished query's shuffles: it asks both collectors to run.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(table: DataFrame) -> None:
    """Deletes a materialized table that nothing will read again."""
    _delete(table.sparkSession, table.written_at)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def n_words(text: Column) -> Column:
    """Words of a text as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that never cut a run of equal ``keys``, from batches sorted by them.

    Only one run is held back at a time; whoever made the keys bounds its size.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and _key(batch, 0, keys) == _key(held[0], 0, keys):
            end = _first_end(batch, keys)
            held.append(batch.slice(0, end))
            if end == batch.num_rows:
                continue
            batch = batch.slice(end)
        if held:
            yield pa.Table.from_batches(held)
        cut = _last_start(batch, keys)
        if cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _key(batch: pa.RecordBatch, row: int, keys: list[str]) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _last_start(batch: pa.RecordBatch, keys: list[str]) -> int:
    """Row at which the last run of equal keys starts (keys are sorted)."""
    last, low, high = _key(batch, batch.num_rows - 1, keys), 0, batch.num_rows - 1
    while low < high:
        mid = (low + high) // 2
        if _key(batch, mid, keys) == last:
            high = mid
        else:
            low = mid + 1
    return low


def _first_end(batch: pa.RecordBatch, keys: list[str]) -> int:
    """Row after the first run of equal keys."""
    first, low, high = _key(batch, 0, keys), 0, batch.num_rows
    while low < high:
        mid = (low + high) // 2
        if _key(batch, mid, keys) == first:
            low = mid + 1
        else:
            high = mid
    return low


def utf8(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty strings."""
    import pyarrow.compute as pc

    return pc.fill_null(column, "") if column.null_count else column


def whole_numbers(vector: Column, scale: int) -> tuple[Column, Column]:
    """Whether a vector holds finite numbers only, also once scaled; and ``floor(scale * x)`` of each as a double.

    ``scale`` is a power of two, so that scaling is exact.
    """
    scaled = F.transform(vector, lambda c: c.cast("double") * F.lit(float(scale)))
    sound = vector.isNotNull() & F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # from 2**52 on a double is whole, and floor would only bring it into a long's range
    return sound, F.transform(scaled, lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c))


LIMB = 31


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers of any size as longs: the sum of limb i times ``2**(LIMB * i)``; all but the last are not negative."""
    out = []
    while len(values) and max(map(abs, values)) >= 1 << LIMB:
        out.append(np.array([int(x) & ((1 << LIMB) - 1) for x in values], np.int64))
        values = np.array([int(x) >> LIMB for x in values], object)
    return [*out, np.array([int(x) for x in values], np.int64)]


def exact_totals(parts: DataFrame, width: int, key: str) -> dict[int, tuple[int, list[int]]]:
    """By key the count and the sums of rows ``key, limb, n, parts`` that tasks made of their own sums.

    The driver gets a row for each key and limb, whatever the number of tasks.
    """
    sums = F.array(*(F.sum(F.get("parts", F.lit(i))) for i in range(width)))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy(key, "limb").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():
        n, total = out.get(r[key], (0, [0] * width))
        out[r[key]] = n + r.n, [t + (s << (LIMB * r.limb)) for t, s in zip(total, r.sums, strict=True)]
    return out


def named(docs: DataFrame) -> tuple[DataFrame, int, list[DataFrame]]:
    """``docs`` (``none``, ``did``, ``text`` and more) with ``did`` a name of its id and text; the bytes of all; tables to delete later.

    Names are in the order of ids, rows without one last.
    """
    h1, h2 = F.xxhash64("none", "text"), F.xxhash64(F.lit(7), "none", "text")
    by_id = docs.groupBy("did").agg(F.sum(F.octet_length("text")).alias("n"), F.min(h1).alias("a"), F.max(h1).alias("b"), F.min(h2).alias("c"), F.max(h2).alias("d"))
    size, shared = by_id.agg(F.sum("n"), F.max((F.col("a") != F.col("b")) | (F.col("c") != F.col("d")))).first()
    if not shared:
        return docs.drop("none"), int(size or 0), []
    key = ["none", "did", "h1", "h2"]
    hashed = docs.withColumns({"h1": h1, "h2": h2})
    names = hashed.select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key)
    names = materialize(names.withColumn("name", F.monotonically_increasing_id()), "names")
    numbered = materialize(hashed.join(names, key).drop(*key).withColumnRenamed("name", "did"), "named")
    return numbered, int(size or 0), [names, numbered]
