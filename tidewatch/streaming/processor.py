"""Structured Streaming twins of the batch operators (S4, S5, S13, W6, X16-X18); those with state per key are in `stateful`, the set tables in `sets`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indicators import COUNTERS

LATENESS = "60 seconds"


def timed(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The events with a watermark on event_time."""
    return events.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", lateness)


def snapshots(events: DataFrame, size: int = 60, every: int = 10, lateness: str = LATENESS, first: bool = False) -> DataFrame:
    """Per tick and address the counters of the last `size` seconds, emitted once the watermark passes.

    `first` adds first_ts, the time of the earliest event among them.
    """
    at = F.window("event_time", f"{size} seconds", f"{every} seconds", "1 second")
    sums = timed(events, lateness).groupBy(at.alias("w"), "source_ip").agg(*[F.sum(c).alias(c) for c in COUNTERS], *[F.min("ts").alias("first_ts")] * first)
    return sums.select((F.unix_timestamp(F.col("w.end")) - 1).alias("tick"), "source_ip", *COUNTERS, *["first_ts"] * first)


def write_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], every: str | None = None):
    """Hand every micro-batch to `write(batch, id)`; without `every` all there is, then stop.

    `write` must be idempotent by id, as a lost batch runs again.
    """
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def report_sink(path: str, most: int = 50) -> Callable[[DataFrame, int], None]:
    """Reports as JSON files of at most `most` events, one folder a batch."""
    return lambda batch, k: batch.write.mode("overwrite").option("maxRecordsPerFile", most).json(f"{path}/batch={k}")
