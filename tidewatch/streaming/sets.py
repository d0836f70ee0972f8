"""The block and allow lists as a table with versions (S12, S14, U6): batches of changes come in, the current state goes out.

A version is the changes of one batch (the last of each address) and a small file that names it; that file appears at
once, so readers see all of a version or nothing. Every so many versions the state as a whole is written, and only later
changes lie over it, so that neither a batch rewrites the state nor a reader goes through all changes. A version that is
there already changes nothing, so a batch that is run again does not either.

One writer at a time, as in a stream's foreachBatch. Folders of earlier versions stay until their
owner clears them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decision import CLOUD_TTL, LOCAL_TTL, ttl

#: set, ip, op (add or del), and for adds the source and the second at which they expire (null: never).
ENTRY = "set string, ip string, op string, source string, expires_at long"
_VERSION = "version long, base long, over array<long>"


class SetTable:
    def __init__(self, spark: SparkSession, path: str, whole_every: int = 20):
        self.spark, self.path, self.whole_every = spark, path.rstrip("/"), whole_every

    def latest(self) -> tuple[int, int, list[int]]:
        """The newest version, the whole state it lies over (-1: none) and the changes over that."""
        try:
            row = self.spark.read.schema(_VERSION).option("recursiveFileLookup", True).json(f"{self.path}/versions").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        return (row["version"], row["base"], list(row["over"])) if row else (-1, -1, [])

    def apply(self, changes: DataFrame, version: int) -> None:
        """Take up a batch of changes (columns of ENTRY and ord, the order within the batch) as `version`, above all before."""
        last, base, over = self.latest()
        if version <= last:
            return
        per = changes.where("ip is not null and ip != ''").groupBy("set", "ip").agg(F.max_by(F.struct("op", "source", "expires_at"), "ord").alias("x"))
        per.select("set", "ip", "x.*").write.mode("overwrite").parquet(f"{self.path}/changes/{version}")
        over = [*over, version]
        if len(over) >= self.whole_every:
            self._state(base, over).write.mode("overwrite").parquet(f"{self.path}/whole/{version}")
            base, over = version, []
        named = self.spark.createDataFrame([(version, base, over)], _VERSION)
        named.coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/version_{version}")

    def _state(self, base: int, over: list[int]) -> DataFrame:
        read = lambda kind, v: self.spark.read.schema(ENTRY).parquet(f"{self.path}/{kind}/{v}").withColumn("_v", F.lit(v).cast("long"))
        parts = ([read("whole", base)] if base >= 0 else []) + [read("changes", v) for v in over]
        if not parts:
            return self.spark.createDataFrame([], ENTRY)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        last = rows.groupBy("set", "ip").agg(F.max_by(F.struct("op", "source", "expires_at"), "_v").alias("x"))
        return last.select("set", "ip", "x.*").where("op = 'add'")

    def current(self, now: Column) -> DataFrame:
        """set, ip, source, expires_at of the members at `now`: what a restore keeps."""
        _, base, over = self.latest()
        return self._state(base, over).where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).drop("op")

    def status(self, now: Column) -> DataFrame:
        """Set, members, with_end (how many expire) at `now`."""
        return self.current(now).groupBy("set").agg(F.count("*").alias("members"), F.count("expires_at").alias("with_end"))

    def command(self, op: str, set: str, ips: list[str], at: int = 0, seconds: int = 0, source: str = "local") -> None:
        """Add or delete addresses by hand, as a version of its own. Blocks end as X5 says, allowed addresses never."""
        rows = self.spark.createDataFrame([(i, set, ip, op, source, at, seconds) for i, ip in enumerate(ips)], "ord long, set string, ip string, op string, source string, at long, seconds long")
        self.apply(entries(rows), self.latest()[0] + 1)

    def sink(self, entry: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: `entry` makes changes of a micro-batch. The table must be that stream's alone."""
        return lambda batch, k: self.apply(entry(batch), k)


def entries(requests: DataFrame, local: int = LOCAL_TTL, cloud: int = CLOUD_TTL) -> DataFrame:
    """Changes of requests (ord, set, ip, op, source, at, seconds): blocks expire by the time to live of their source (X5; `local` and `cloud` are settings)."""
    end = F.when((F.col("set") == "black") & (F.col("op") == "add"), F.col("at") + ttl(F.col("seconds"), F.col("source"), local, cloud))
    return requests.select("ord", "set", "ip", "op", "source", end.cast("long").alias("expires_at"))


def blocked(accepted: DataFrame, seconds: int = 3600) -> DataFrame:
    """Changes of a micro-batch of block requests (source_ip, ts, seq, accepted)."""
    rows = accepted.where("accepted").select(F.col("seq").alias("ord"), F.lit("black").alias("set"), F.col("source_ip").alias("ip"), F.lit("add").alias("op"), F.lit("local").alias("source"), F.col("ts").alias("at"), F.lit(seconds).cast("long").alias("seconds"))
    return entries(rows)
