"""Counts that grow by batches: an append-only log with snapshots, for feedback and other statistics.

A batch is added up by its keys and written to a folder of its own, named by writer and number, so
a batch that is run again replaces itself and two writers never touch each other's. A snapshot
holds the sum of all folders that it lists; only a snapshot whose rows are complete (``_SUCCESS``)
counts, and only then are the folders deleted. Readers add the newest snapshot and the folders
that it doesn't list. Any number may write and read; one process at a time may compact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from peneira.plans import feedback as B


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass(frozen=True)
class CountLog:
    """Sums of ``sums`` by ``keys`` under ``path``, a folder that all executors share; keys may be null."""

    spark: SparkSession
    path: str
    keys: Sequence[str]
    sums: Sequence[str]
    schema: str

    def _names(self, folder: str) -> list[str]:
        return _names(self.spark, f"{self.path}/{folder}")

    def _delete(self, folder: str) -> None:
        _delete(self.spark, f"{self.path}/{folder}")

    def _complete(self, folder: str) -> bool:
        return "_SUCCESS" in self._names(folder)

    def added(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.sums))

    def append(self, rows: DataFrame, number: int, writer: str = "w") -> None:
        """Adds a batch; the same writer and number again replace it."""
        self.added(rows).write.mode("overwrite").parquet(f"{self.path}/batches/{writer}-{number:012d}")

    def _state(self) -> tuple[str | None, list[str], list[str]]:
        """The newest complete snapshot, the batches that it lists, and those it doesn't."""
        snaps = [s for s in self._names("snaps") if self._complete(f"snaps/{s}/rows")]
        last = snaps[-1] if snaps else None
        listed = [r.name for r in self.spark.read.parquet(f"{self.path}/snaps/{last}/names").collect()] if last else []
        fresh = [b for b in self._names("batches") if b not in set(listed) and self._complete(f"batches/{b}")]
        return last, listed, fresh

    def read(self) -> DataFrame:
        """The sums of all complete batches."""
        last, _, fresh = self._state()
        paths = [f"{self.path}/batches/{b}" for b in fresh] + ([f"{self.path}/snaps/{last}/rows"] if last else [])
        return self.added(self.spark.read.schema(self.schema).parquet(*paths)) if paths else self.spark.createDataFrame([], self.schema)

    def compact(self) -> None:
        """Writes a snapshot of what is there, then deletes the batches it lists and the snapshot before.

        A writer must not run a batch again once a snapshot lists it; a stream's sink asks ``listed`` first.
        """
        last, listed, fresh = self._state()
        if not fresh:
            return
        there = set(self._names("batches"))
        number = f"{int(last) + 1 if last else 0:012d}"
        # of deleted batches each writer's last stays listed, so that it is known when it comes again
        newest = {n.rpartition("-")[0]: n for n in sorted([*listed, *fresh])}
        names = sorted({n for n in listed if n in there} | set(fresh) | set(newest.values()))
        rows = self.read()
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snaps/{number}/names")
        rows.write.mode("overwrite").parquet(f"{self.path}/snaps/{number}/rows")
        for n in names:
            self._delete(f"batches/{n}")
        if last:
            self._delete(f"snaps/{last}")

    def listed(self, number: int, writer: str = "w") -> bool:
        """Whether a snapshot holds this batch already: a writer's numbers rise, so one up to its last listed does."""
        return any(n.rpartition("-")[0] == writer and int(n.rpartition("-")[2]) >= number for n in self._state()[1])


@dataclass(frozen=True)
class KeyedTable:
    """The latest row of each key under ``path``, in buckets by the key's hash; an upsert rewrites only the buckets it touches.

    Each upsert is a generation, a folder that counts once it is complete. A bucket's rows are those
    of the newest generation that has it, so a reader sees an upsert whole or not at all, and one
    that fails leaves nothing. One process at a time may write. Of equal times the later upsert wins,
    within one the greatest row. Null keys are keys.
    """

    spark: SparkSession
    path: str
    keys: Sequence[str]
    when: str
    schema: str
    buckets: int = 64

    def _newest(self) -> dict[int, int]:
        """The newest complete generation of each bucket: as many entries as buckets."""
        out = {}
        for name in _names(self.spark, self.path):
            inside = _names(self.spark, f"{self.path}/{name}")
            if "_SUCCESS" in inside:
                out |= {int(b.partition("=")[2]): int(name) for b in inside if b.startswith("_bucket=")}
        return out

    def _read(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/{g:012d}/_bucket={b}" for b, g in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._newest())

    def upsert(self, changes: DataFrame) -> list[int]:
        """Puts each change in place of the row of its key, unless that is newer; gives the buckets rewritten."""
        held = self._newest()
        number = max((int(n) for n in _names(self.spark, self.path)), default=-1) + 1
        columns = self.spark.createDataFrame([], self.schema).columns
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        news = changes.select(*columns).withColumns({"_bucket": bucket, "_turn": F.lit(1)})
        touched = sorted(r[0] for r in news.select("_bucket").distinct().collect())
        old = self._read({b: g for b, g in held.items() if b in touched}).select(*columns).withColumns({"_bucket": bucket, "_turn": F.lit(0)})
        row = F.struct(F.col(self.when), "_turn", *(c for c in columns if c != self.when))
        latest = old.unionByName(news).groupBy("_bucket", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))).agg(F.max(row).alias("_r"))
        # rows of a bucket spread over tasks by key, so a great bucket does not gather in one
        latest.select("_bucket", *(F.col("_r")[c].alias(c) for c in columns)).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{number:012d}")
        for b, g in held.items():
            if b in touched:
                _delete(self.spark, f"{self.path}/{g:012d}/_bucket={b}")
        return touched


def feedback_log(spark: SparkSession, path: str) -> CountLog:
    """A log of training rows by source, kind and score: all that the calibration needs."""
    return CountLog(spark, path, ("fonte", "tipo", "score"), ("total", "count"), B.COUNTS)


def recalibrate_stream(feedback: DataFrame, log: CountLog, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, compact_every: int = 64) -> StreamingQuery:
    """After each micro-batch ``sink`` gets the points and the history rows of fits to all feedback so far.

    Only the batch's rows are read anew; the rest comes from the log's counts. A batch that is run again counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not log.listed(number):
            log.append(B.score_counts(B.training_rows(batch)), number)
        points, history = B.recalibrate_counts(log.read())
        sink(points, history, number)
        if number % compact_every == compact_every - 1:
            log.compact()

    return feedback.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
