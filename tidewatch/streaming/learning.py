"""Baselines learnt in a stream (B10, B11, B17, X16): each tick's percentiles fold into a table that later batches read.

All addresses of a tick leave the windows of `processor.snapshots` in the micro-batch in which the watermark passes it, so a
batch holds whole ticks, later than those of every batch before it. A batch becomes a version: the baseline after each of
its ticks, the last one of every dimension (nine rows, where the next batch goes on), and a small file that names the
version and appears at once. A batch that is run again changes nothing.

One writer at a time. A reader takes the versions that its events can ask for, not the table's whole past. Folders of
older versions stay until their owner clears them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline

_VERSION = "version long, start long, first long, last long"


class Version(NamedTuple):
    """A batch that has been learnt: its number, when learning began, its first and last tick."""

    version: int
    start: int
    first: int
    last: int


class BaselineTable:
    """The baselines of windows of `size` seconds, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, size: int = 60):
        self.spark, self.path, self.size = spark, path.rstrip("/"), size

    def versions(self) -> list[Version]:
        """All versions in order; one row a batch that had ticks."""
        try:
            rows = self.spark.read.schema(_VERSION).option("recursiveFileLookup", True).json(f"{self.path}/versions").orderBy("version").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return [Version(*r) for r in rows]

    def apply(self, snapshots: DataFrame, version: int) -> None:
        """For foreachBatch: learn from the ticks of `processor.snapshots(..., first=True)`. The table must be that stream's alone."""
        known = self.versions()
        if known and known[-1].version >= version:
            return
        snapshots = snapshots.persist()
        try:
            first, last, began = snapshots.agg(F.min("tick"), F.max("tick"), F.min("first_ts")).first()
            if first is None:
                return
            start = known[-1].start if known else began
            before = self._read("last", [known[-1].version]) if known else None
            ticks = baseline.tick_percentiles(snapshots, self.size)
            baseline.baselines(ticks, F.lit(start), before).write.mode("overwrite").parquet(f"{self.path}/ticks/{version}")
        finally:
            snapshots.unpersist()
        new = self._read("ticks", [version])
        both = new if before is None else new.unionByName(before)
        ends = both.groupBy("dim").agg(F.max_by(F.struct("tick", "p50", "p95", "p99", "n"), "tick").alias("x"))
        ends.select("x.tick", "dim", "x.p50", "x.p95", "x.p99", "x.n").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/last/{version}")
        named = self.spark.createDataFrame([Version(version, start, first, last)], _VERSION)
        named.coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/version_{version}")

    def _read(self, kind: str, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], baseline.BASELINE)
        return self.spark.read.schema(baseline.BASELINE).parquet(*[f"{self.path}/{kind}/{v}" for v in versions])

    def ticks(self, since: int | None = None) -> DataFrame:
        """The baseline after each tick; with `since` (Unix seconds) only what an event of that time or later can ask for."""
        return self._ticks(self.versions(), since)

    def _ticks(self, known: list[Version], since: int | None) -> DataFrame:
        if since is None:
            return self._read("ticks", [v.version for v in known])
        older = [v.version for v in known if v.last < since]
        # What held before the first version taken: its dimensions' last rows.
        return self._read("ticks", [v.version for v in known if v.last >= since]).unionByName(self._read("last", older[-1:]))

    def learnt(self, events: DataFrame, name: str, conf: float = baseline.CONFIDENCE) -> DataFrame:
        """B11, B17 for a micro-batch: the events with the baseline as of each, of what has been learnt by now (`baseline.learnt`)."""
        known = self.versions()
        low = events.agg(F.min("ts")).first()[0]
        start = F.lit(known[0].start if known else None).cast("long")
        since = None if low is None else low // baseline.TICK * baseline.TICK
        return baseline.learnt(events, self._ticks(known, since), start, name, conf=conf)
