"""Incremental ingestion with Structured Streaming: changed documents replace their stored rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Buckets


def ingest(spark: SparkSession, source: str, schema: str, root: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, key: str = "doc_id", version: str = "version", buckets: int = 64, once: bool = True) -> StreamingQuery:
    """Streams Parquet files of ``source`` into the buckets of a table below ``root``; see ``store.Buckets``.

    In each micro-batch the newest version of a key counts, and it replaces what is stored unless that is newer, so a
    replayed batch changes nothing. A batch rewrites only the buckets of its keys. ``once`` stops when all files that are
    there have been read.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            Buckets(batch.sparkSession, root, key, buckets).merge(transform(batch), version)

    stream = spark.readStream.schema(schema).parquet(source)
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes", by: str = "event_type") -> DataFrame:
    """Counts by window and kind, late rows up to ``late`` included; works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
