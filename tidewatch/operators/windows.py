"""Windowed aggregation.

Skew: an address may have a third of all events. Its windows look back at most
`span` seconds, so rows are dealt over (address, chunk of time); the rows of the last
`span` seconds before a chunk are copied into it as context and dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import scalars as S
from .indicators import COUNTERS

CHUNK = 3600


def chunked(events: DataFrame, span: int, chunk: int = CHUNK) -> DataFrame:
    """Rows with _chunk, and copies (_own false) of those whose next chunk needs them."""
    c = F.floor(F.col("ts") / chunk)
    needed = F.col("ts") % chunk >= chunk - span
    both = F.when(needed, F.array(c, c + 1)).otherwise(F.array(c))
    return events.withColumn("_chunk", F.explode(both)).withColumn("_own", F.col("_chunk") == c)


def _frames(key: str):
    part = Window.partitionBy(key, "_chunk")
    so_far = part.orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda w: part.orderBy("ts").rangeBetween(Window.unboundedPreceding, -w)
    return part, so_far, before


def trailing_counters(events: DataFrame, sizes: Sequence[int] = (10, 30, 60), counters: Sequence[str] = COUNTERS) -> DataFrame:
    """For each event and window size the sums over the address's events in (ts - size, ts] up to this event.

    A running sum less the running sum up to `size` seconds ago: one exchange, one sort.
    """
    _, so_far, before = _frames("source_ip")
    wide = chunked(events, max(sizes)).withColumns({f"_s_{c}": F.sum(c).over(so_far) for c in counters})
    sums = {f"{c}_{w}": F.col(f"_s_{c}") - F.coalesce(F.sum(c).over(before(w)), F.lit(0)) for w in sizes for c in counters}
    return wide.withColumns(sums).where("_own").drop("_chunk", "_own", *(f"_s_{c}" for c in counters))


def trailing_distinct(rows: DataFrame, key: str, kinds: dict[str, Column], value: Column, sizes: Sequence[int]) -> DataFrame:
    """Add NAME_W for each kind and size: the distinct `value` of the key's rows of that kind in (ts - W, ts] up to this row.

    A value enters a window with a row that finds no equal one in the W seconds before it, and leaves it W seconds after
    a row that no equal one follows within W seconds. So a count is a running sum of entries less one of exits: two sorts
    of one exchange, and no list however fast a key is. Kinds must exclude each other; rows of no kind count nothing.
    """
    kind = F.coalesce(*[F.when(c, F.lit(n)) for n, c in kinds.items()])
    wide = chunked(rows, max(sizes)).withColumns({"_kind": kind, "_value": F.when(kind.isNotNull(), value)}).repartition(key, "_chunk")
    same = Window.partitionBy(key, "_chunk", "_kind", "_value").orderBy("ts", "seq")
    wide = wide.withColumns({"_past": F.col("ts") - F.lag("ts").over(same), "_next": F.lead("ts").over(same) - F.col("ts")})
    _, so_far, before = _frames(key)
    one = lambda gap, w, n: F.when((F.col("_kind") == n) & (F.coalesce(F.col(gap), F.lit(w)) >= w), 1).otherwise(0)
    sums = {f"{n}_{w}": (F.sum(one("_past", w, n)).over(so_far) - F.coalesce(F.sum(one("_next", w, n)).over(before(w)), F.lit(0))).cast("long") for w in sizes for n in kinds}
    return wide.withColumns(sums).where("_own").drop("_chunk", "_own", "_kind", "_value", "_past", "_next")


def distinct_bases(events: DataFrame, sizes: Sequence[int] = (10, 30, 60)) -> DataFrame:
    """Distinct normalised paths of 404s (d404_W) and of other 4xx but 499 (d4xx_W) in the trailing windows."""
    status = F.col("status")
    kinds = {"d404": status == 404, "d4xx": status.between(400, 498) & (status != 404)}
    base = F.col("_base") if "_base" in events.columns else S.normalize_404_path(F.col("path"))
    return trailing_distinct(events, "source_ip", kinds, base, sizes).drop("_base")


def window_counters(events: DataFrame, sizes: Sequence[int] = (10, 30, 60)) -> DataFrame:
    """W2-W4 together: c404_W is no more than the distinct bases, and d4xx_W no more than c4xx_W."""
    out = distinct_bases(trailing_counters(events, sizes), sizes)
    least = {f"c404_{w}": F.least(f"c404_{w}", f"d404_{w}") for w in sizes}
    least |= {f"d4xx_{w}": F.least(f"c4xx_{w}", f"d4xx_{w}") for w in sizes}
    return out.withColumns(least)


def sessions(events: DataFrame, idle: int = 300, key: str = "source_ip") -> DataFrame:
    """`session`, counted from 0 per address; a gap of `idle` seconds starts a new one.

    Gaps are found per (address, chunk). A small table of one row per (address, chunk) carries the last time and the
    number of sessions of earlier chunks, so no window holds all events of one address.
    """
    rows = events.withColumn("_c", F.floor(F.col("ts") / CHUNK))

    def carried(df: DataFrame, each: Column, over: Column, name: str) -> DataFrame:
        chunks = df.groupBy(F.col(key).alias("_k"), F.col("_c").alias("_d")).agg(each.alias("_v"))
        ends = chunks.select("_k", "_d", over.over(Window.partitionBy("_k").orderBy("_d")).alias(name))
        return df.join(ends, F.col(key).eqNullSafe(F.col("_k")) & F.col("_c").eqNullSafe(F.col("_d")), "left").drop("_k", "_d")

    w = Window.partitionBy(key, "_c").orderBy("ts", "seq")
    new = F.when(F.col("ts") - F.coalesce(F.lag("ts").over(w), "_last") >= idle, 1).otherwise(0)
    marked = carried(rows, F.max("ts"), F.lag("_v"), "_last").withColumn("_new", new)
    counted = carried(marked, F.sum("_new"), F.sum("_v"), "_before")
    # `_before` holds the own chunk too.
    own = F.sum("_new").over(Window.partitionBy(key, "_c"))
    return counted.withColumn("session", (F.col("_before") - own + F.sum("_new").over(w)).cast("long")).drop("_c", "_last", "_before", "_new")


def snapshots(events: DataFrame, size: int = 60, every: int = 10, counters: Sequence[str] = COUNTERS) -> DataFrame:
    """Per tick and address the raw counters of (tick - size, tick]; works on streams with a watermark too."""
    at = F.window(F.timestamp_seconds("ts"), f"{size} seconds", f"{every} seconds", "1 second")
    sums = events.groupBy(at.alias("w"), "source_ip").agg(*[F.sum(c).alias(c) for c in counters])
    return sums.select((F.unix_timestamp(F.col("w.end")) - 1).alias("tick"), "source_ip", *counters)


def panes(events: DataFrame, every: int = 10, counters: Sequence[str] = COUNTERS) -> DataFrame:
    """ts, source_ip and the counters of each address in (ts - every, ts]: `snapshots` of sizes that are multiples of `every` are the same over them."""
    return snapshots(events, every, every, counters).withColumnRenamed("tick", "ts")


def port_scans(ports: DataFrame, limits: Sequence[tuple[int, int]] = ((5, 5), (30, 15), (120, 40)), weight: int = 30) -> DataFrame:
    """The first event of each address at which some window holds more distinct ports than its limit."""
    counts = [f"ports_{w}" for w, _ in limits]
    seen = trailing_distinct(ports, "src_ip", {"ports": F.lit(True)}, F.col("dst_port"), [w for w, _ in limits])
    breach = S.any_of([F.col(f"ports_{w}") > most for w, most in limits])
    first = F.min(F.struct("ts", "seq", "dst_port", *counts)).alias("f")
    return seen.where(breach).groupBy("src_ip").agg(first).select("src_ip", "f.*", F.lit(weight).cast("long").alias("score"))


def buckets(events: DataFrame, size: int = 300) -> DataFrame:
    """Five-minute counts of requests and of status classes as the preload sees them."""
    n = lambda c: F.count_if(c)
    s = F.col("status")
    return events.groupBy((F.floor(F.col("ts") / size) * size).cast("long").alias("bucket")).agg(
        F.count("*").alias("total"),
        n(s == 404).alias("n404"),
        n(s.isin(401, 403)).alias("auth"),
        n(s.isin(401, 403, 400, 405, 408, 429, 422)).alias("n4xx"),
        n(s.between(500, 504)).alias("n5xx"),
    )


def latest(events: DataFrame, keep: int = 512) -> DataFrame:
    """W11 at the end of the data: the last `keep` events of each address, with pos from 1 (oldest).

    The busiest addresses are cut per (address, second-of-time chunk) first, so no window holds all events of one address.
    """
    newest = lambda *by: F.row_number().over(Window.partitionBy("source_ip", *by).orderBy(F.desc("ts"), F.desc("seq")))
    some = events.withColumn("_c", F.floor(F.col("ts") / CHUNK)).withColumn("_n", newest("_c")).where(F.col("_n") <= keep)
    last = some.withColumn("_n", newest()).where(F.col("_n") <= keep)
    up = Window.partitionBy("source_ip").orderBy("ts", "seq")
    return last.withColumn("pos", F.row_number().over(up).cast("long")).drop("_n", "_c")


def ema(events: DataFrame, size: int = 10, decay: float = 0.95) -> DataFrame:
    """Seen and the moving average of (events of this second so far) / size, over one idle session.

    A step of the average is an affine map, and so is a chunk of them: decay to the power of its rows, and what the chunk
    adds when it starts from nothing. These two numbers per (address, session, chunk) are a small table; running through
    it gives where each chunk starts. Then chunks stream apart from each other through sorted partitions, so an address
    that never idles is as many pieces as hours.
    """
    key = ["source_ip", "session", "_c"]
    rows = sessions(events).withColumn("_c", F.floor(F.col("ts") / CHUNK))
    second, rest = Window.partitionBy(*key, "ts").orderBy("seq"), Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("seq"))
    steps = rows.select(*key, F.row_number().over(second).alias("n"), (F.row_number().over(rest) - 1).alias("after"))
    chunks = steps.groupBy(*key).agg(F.count("*").alias("rows"), F.sum((1 - decay) * F.col("n") / size * F.pow(F.lit(decay), F.col("after"))).alias("adds"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, e = None, 0, 0.0
        for batch in batches:
            out = []
            for ip, session, n, adds in zip(*(batch.column(c).to_pylist() for c in ("source_ip", "session", "rows", "adds"))):
                if (ip, session) != key:
                    key, seen, e = (ip, session), 0, 0.0
                out.append((seen, e))
                seen, e = seen + n, e * decay**n + adds
            before, start = zip(*out) if out else ((), ())
            yield pa.record_batch([*(batch.column(c) for c in ("source_ip", "session", "_c")), pa.array(before, pa.int64()), pa.array(start, pa.float64())], names=["_ip", "_session", "_chunk", "_before", "_start"])

    dealt = chunks.repartition("source_ip", "session").sortWithinPartitions("source_ip", "session", "_c")
    starts = dealt.mapInArrow(carry, "_ip string, _session long, _chunk long, _before long, _start double")
    on = F.col("source_ip").eqNullSafe(F.col("_ip")) & (F.col("session") == F.col("_session")) & F.col("_c").eqNullSafe(F.col("_chunk"))
    begun = rows.join(starts, on, "left").drop("_ip", "_session", "_chunk").repartition(*key).sortWithinPartitions(*key, "ts", "seq")
    kept = [f for f in begun.schema.fields if f.name not in ("_c", "_before", "_start")]
    schema = StructType([*kept, StructField("seen", LongType()), StructField("ema", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, second, n, seen, e = None, None, 0, 0, 0.0
        for batch in batches:
            counts, means = [], []
            for ip, session, chunk, ts, before, start in zip(*(batch.column(c).to_pylist() for c in ("source_ip", "session", "_c", "ts", "_before", "_start"))):
                if (ip, session, chunk) != key:
                    key, second, n, seen, e = (ip, session, chunk), None, 0, before, start
                n = n + 1 if ts == second else 1
                second, seen, e = ts, seen + 1, decay * e + (1 - decay) * n / size
                counts.append(seen)
                means.append(e)
            yield pa.record_batch([*(batch.column(f.name) for f in kept), pa.array(counts, pa.int64()), pa.array(means, pa.float64())], names=[*(f.name for f in kept), "seen", "ema"])

    return begun.mapInArrow(run, schema)
