"""Detection over streams of documents.

Detection is stateless for a document, but voting groups a document's findings, so
each micro-batch is detected as a table. Metrics over time use a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from peneira.operators.rules import judge
from peneira.plans.detect import Engine, detect


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, ts timestamp", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def detect_stream(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, engine: Engine = Engine()) -> StreamingQuery:
    """Detects each micro-batch and hands it to ``sink``; a batch that is run again gets the same number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(detect(batch, engine), number)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def matches_by_window(docs: DataFrame, engine: Engine = Engine(), window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Accepted matches by kind and time window, in one stateless pass and one aggregation."""
    found = judge(docs.withWatermark("ts", late), engine.patterns)
    return found.groupBy(F.window("ts", window), "tipo").agg(F.count("*").alias("n"))
