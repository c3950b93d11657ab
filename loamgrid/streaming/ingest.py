"""Streams: files that arrive, change feeds applied batch by batch, and progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """ST1: Parquet files of a folder as they arrive; the batch size is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def applied_feed(feed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """ST2, ST3, ST5: everything available is applied batch by batch, each at least once; the
    checkpoint resumes after a failure. A scheduler outside starts it when sources are due."""
    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_feed(engine: Engine, feed: DataFrame, checkpoint: str) -> StreamingQuery:
    """Each batch of files is a delta: it replaces its own paths, and a null content removes one.

    Files that a batch does not mention are not touched. A batch that is applied again changes nothing.
    """
    return applied_feed(feed, lambda batch, _: engine.sync(batch, whole=False), checkpoint)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events and values of each type in windows of event time; rows later than ``late`` are left out
    of a stream, and a batch has none."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def progress(events: DataFrame) -> DataFrame:
    """ST4, A21: files seen and done of each source so far."""
    return events.groupBy("data_source_id").agg(F.count("*").alias("seen"), F.sum((F.col("status") == "completed").cast("long")).alias("done"))
