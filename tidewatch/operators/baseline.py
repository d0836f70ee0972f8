"""Baseline statistics (B1-B17). Percentiles are elements of the sorted sample at a whole index, not interpolated.

Samples are first counted by value, so a tick with millions of addresses is sorted by its
distinct values only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

DIMS = ("qps", "r4xx", "r5xx", "r404", "auth", "sens", "bot", "empty_ref", "head")
RATES = DIMS[1:]
MIN_QPS, FLOOR_P95, DECAY, QUICK_DECAY, WARM_UP, TICK = 1.0, 0.001, 0.8, 0.5, 1800, 10
#: When a baseline may be used, and how far one is trusted that no preload has judged.
READY_SAMPLES, READY_AGE, CONFIDENCE = 100, 300, 0.5
BASELINE = "tick long, dim string, p50 double, p95 double, p99 double, n long"


def histogram(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Counts of the sample's values; not-a-number and infinite values go, negative ones become 0."""
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return samples.where(ok).groupBy(*keys, F.greatest(v, F.lit(0.0)).alias("value")).agg(F.count("*").alias("cnt"))


def _ranked(h: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return h.withColumns({"cum": F.sum("cnt").over(w), "n": F.sum("cnt").over(Window.partitionBy(*keys))})


def _at(index: Column, value: str = "value", cum: str = "cum") -> Column:
    """The element of the sorted sample at a 0-based index."""
    return F.min(F.when(F.col(cum) > index, F.col(value)))


def _half() -> Column:
    return F.floor(F.col("n") / 2)


def mad_trim(h: DataFrame, keys: list[str], k: float = 5.0) -> DataFrame:
    """B2: drop values above median + k x median absolute deviation; samples under five and zero deviations stay whole."""
    whole = Window.partitionBy(*keys)
    x = _ranked(h, keys).withColumn("med", _at(_half()).over(whole)).withColumn("dev", F.abs(F.col("value") - F.col("med")))
    by_dev = whole.orderBy("dev").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("dcum", F.sum("cnt").over(by_dev)).withColumn("mad", _at(_half(), "dev", "dcum").over(whole))
    keep = (F.col("n") < 5) | (F.col("mad") <= 0) | (F.col("value") <= F.col("med") + k * F.col("mad"))
    return x.where(keep).select(*keys, "value", "cnt")


def p99_trim(h: DataFrame, keys: list[str], times: float = 10.0) -> DataFrame:
    """Drop values above `times` the 99th percentile."""
    x = _ranked(h, keys).withColumn("p99", _at(F.floor(F.col("n") * 0.99)).over(Window.partitionBy(*keys)))
    keep = (F.col("n") < 5) | (F.col("p99") <= 0) | (F.col("value") <= times * F.col("p99"))
    return x.where(keep).select(*keys, "value", "cnt")


def percentiles(h: DataFrame, keys: list[str]) -> DataFrame:
    """B1: keys, p50, p95, p99, n."""
    x = _ranked(h, keys)
    return x.groupBy(*keys).agg(_at(_half()).alias("p50"), _at(F.floor(F.col("n") * 0.95)).alias("p95"), _at(F.floor(F.col("n") * 0.99)).alias("p99"), F.max("n").alias("n"))


def attacker(min_total: int = 5) -> Column:
    """Snapshots that must not teach the baseline."""
    r = lambda c: S.ratio(F.col(c), F.col("total"))
    return (F.col("total") < min_total) | (r("c4xx") > 0.8) | (r("c404") > 0.8) | (r("bot") > 0.9) | (F.col("danger") >= 3) | (F.col("trav") >= 3)


def samples(snapshots: DataFrame, size: int) -> DataFrame:
    """tick, dim, value of the snapshots that pass the filter."""
    rate = {"r4xx": "c4xx", "r5xx": "c5xx", "r404": "c404", "auth": "auth_fail", "sens": "sens", "bot": "bot", "empty_ref": "empty_ref", "head": "head"}
    values = {"qps": F.col("total") / F.lit(float(size))} | {d: S.ratio(F.col(c), F.col("total")) for d, c in rate.items()}
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), v.cast("double").alias("value")) for d, v in values.items()])).alias("x")
    return snapshots.where(~attacker()).select("tick", each).select("tick", "x.*")


def tick_percentiles(snapshots: DataFrame, size: int) -> DataFrame:
    """Per tick and dimension: percentiles after both trims."""
    keys = ["tick", "dim"]
    return percentiles(p99_trim(mad_trim(histogram(samples(snapshots, size), keys), keys), keys), keys)


def min_qps(p95: Column, n: Column) -> Column:
    """B6."""
    return F.when((n == 0) | (p95 <= 0), MIN_QPS).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(50.0), p95 * 0.1)))


def guard_qps(p95: Column, n: Column) -> Column:
    """Below this rate relative scores do not count."""
    return F.when((n == 0) | (p95 <= 0), 0.3).otherwise(F.greatest(p95 * 0.02, F.lit(0.05)))


def thresholds(p50: Column, p95: Column, n: Column, conf: Column) -> Column:
    """Deviation thresholds for the three sensitivities."""
    r = F.greatest(F.lit(1.01), F.least(F.lit(10.0), p95 / F.greatest(p50, F.lit(0.5))))
    own = F.array(*[F.least(F.greatest(r * m, F.lit(low)), F.lit(15.0)) for m, low in ((1.2, 1.5), (1.5, 2.0), (2.5, 3.0))])
    return F.when((conf < 0.5) | (n == 0) | (p50 <= 0), F.array(F.lit(2.0), F.lit(5.0), F.lit(10.0))).otherwise(own)


def sensitivity(seen: Column, base: int = 2) -> Column:
    """B13."""
    return F.when(seen < 20, 1).when(seen > 1000, 3).otherwise(base)


def _least_qps(p95: float, n: int) -> float:
    return MIN_QPS if n == 0 or p95 <= 0 else max(0.5, min(50.0, p95 * 0.1))


def _floored(p: tuple) -> tuple:
    """Floors of a rate's (p50, p95, p99, n)."""
    return p if p[3] == 0 else (max(p[0], FLOOR_P95 * 0.3), max(p[1], FLOOR_P95), max(p[2], FLOOR_P95 * 3), p[3])


def _merged(old: tuple, new: tuple, d: float) -> tuple:
    """B9."""
    return old if new[3] == 0 else (*(o * d + v * (1 - d) for o, v in zip(old[:3], new[:3])), new[3])


def _folded(dim: str, old: tuple, new: tuple, d: float) -> tuple:
    """The baseline after one more tick."""
    if dim != "qps":
        new = _floored(new)
        return new if old[3] == 0 else _floored(_merged(old, new, d))
    low = _least_qps(old[1], old[3]) if old[3] > 0 and old[1] > 0 else _least_qps(MIN_QPS, 1)
    if new[1] < low:
        new = (max(new[0], low * 0.3), low, max(new[2], low * 2), new[3])
    if old[3] == 0:
        return new
    both = _merged(old, new, d)
    return (both[0], max(both[1], _least_qps(both[1], both[3])), both[2], both[3])


def baselines(ticks: DataFrame, start: Column, before: DataFrame | None = None) -> DataFrame:
    """The baseline after each tick: tick, dim, p50, p95, p99, n. `start` is when learning began (Unix seconds).

    Ticks fold in order with a decay of 0.8 (0.5 in the first half hour), one pass for each dimension over its sorted
    ticks, of which there is one in ten seconds whatever the traffic. `before` has the rows of the last earlier tick of each
    dimension, which go in first and do not come out.
    """
    d = F.when(F.col("tick") - start < WARM_UP, QUICK_DECAY).otherwise(DECAY)
    pick = lambda df, d: df.select("dim", "tick", "p50", "p95", "p99", F.col("n").cast("long").alias("n"), d.alias("d"))
    rows = pick(ticks, d)
    if before is not None:
        rows = rows.unionByName(pick(before, F.lit(None).cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, (0.0, 0.0, 0.0, 0)
        for batch in batches:
            out = []
            for dim, tick, p50, p95, p99, n, decay in zip(*(c.to_pylist() for c in batch.columns)):
                if dim != key:
                    key, state = dim, (0.0, 0.0, 0.0, 0)
                if decay is None:
                    state = (p50, p95, p99, n)
                    continue
                state = _folded(dim, state, (p50, p95, p99, n), decay)
                out.append((tick, dim, *state))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], names=names)

    names = ["tick", "dim", "p50", "p95", "p99", "n"]
    kinds = [pa.int64(), pa.string(), *[pa.float64()] * 3, pa.int64()]
    return rows.repartition("dim").sortWithinPartitions("dim", "tick").mapInArrow(run, BASELINE)


def learnt(events: DataFrame, ticks: DataFrame, start: Column, name: str, every: int = TICK, conf: float = CONFIDENCE) -> DataFrame:
    """The events with a struct `name`, the baseline that holds at each (see `all_learnt`)."""
    return all_learnt(events, {name: ticks}, start, every, conf)


def all_learnt(events: DataFrame, ticks: dict[str, DataFrame], start: Column, every: int = TICK, conf: float = CONFIDENCE, times: DataFrame | None = None) -> DataFrame:
    """The events with a struct for each name in `ticks`, the baseline of these that holds at each: {dim}_p50, _p95, _n, conf, own_*.

    The last tick up to an event's own one counts. Until the tick has READY_SAMPLES samples over all dimensions and
    learning is READY_AGE seconds old, wide defaults of no confidence stand in; own_qps_* and own_conf are what has been
    learnt in any case. Events without a time get the defaults. All names are joined at once, as the events are wide;
    `times` has their times (ts) where the events themselves are dear to work out twice.
    """
    at = (F.floor(F.col("ts") / every) * every).cast("long")
    value = "struct<p50:double,p95:double,n:bigint>"
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(d).alias("dim")) for name in ticks for d in DIMS])).alias("x")
    asked = (events if times is None else times).select(at.alias("tick")).where("tick is not null").distinct().select("tick", each).select("tick", "x.*", F.lit(None).cast(value).alias("p"))
    known = reduce(DataFrame.unionByName, [t.select("tick", F.lit(name).alias("name"), "dim", F.struct("p50", "p95", "n").cast(value).alias("p")) for name, t in ticks.items()], asked)
    past = Window.partitionBy("name", "dim").orderBy("tick").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    each = known.withColumn("p", F.last("p", ignorenulls=True).over(past))
    pick = lambda name, d, k: F.coalesce(F.max(F.when((F.col("name") == name) & (F.col("dim") == d), F.col("p").getField(k))), F.lit(0)).alias(f"{d}_{k}")
    wide = each.groupBy(F.col("tick").alias("_at")).agg(*[F.struct(*[pick(name, d, k) for d in DIMS for k in ("p50", "p95", "n")]).alias(f"_own_{name}") for name in ticks])
    both = events.withColumn("_tick", at).join(wide, F.col("_tick") == F.col("_at"), "left")
    bases = {}
    for name in ticks:
        own = lambda f, name=name: F.coalesce(F.col(f"_own_{name}").getField(f), F.lit(0))
        total = sum((own(f"{d}_n") for d in DIMS), F.lit(0))
        both = both.withColumn(f"_ready_{name}", F.coalesce((total >= READY_SAMPLES) & (F.col("ts") - start >= READY_AGE), F.lit(False)))
        ready = lambda f, other, name=name, own=own: F.when(F.col(f"_ready_{name}"), own(f)).otherwise(F.lit(other)).alias(f)
        dims = [x for d in DIMS for x in (ready(f"{d}_p50", 0.0), ready(f"{d}_p95", 1000.0 if d == "qps" else 1.0), ready(f"{d}_n", 0))]
        conf_now = F.when(F.col(f"_ready_{name}"), F.lit(conf)).otherwise(F.lit(0.0)).alias("conf")
        raw = [own(f"qps_{k}").alias(f"own_qps_{k}") for k in ("p50", "p95", "n")]
        bases[name] = F.struct(*dims, conf_now, *raw, F.lit(conf).alias("own_conf"))
    return both.withColumns(bases).drop("_tick", "_at", *(f"_{x}_{name}" for name in ticks for x in ("own", "ready")))


def columns(name: str) -> dict[str, Column]:
    """The fields of a struct that `learnt` has added, by name."""
    fields = [f"{d}_{k}" for d in DIMS for k in ("p50", "p95", "n")] + ["conf", "own_conf", *(f"own_qps_{k}" for k in ("p50", "p95", "n"))]
    return {f: F.col(name).getField(f) for f in fields}


def as_of(events: DataFrame, ticks: DataFrame, every: int = TICK) -> DataFrame:
    """Each event with the QPS baseline of the last tick before it, by an equal join on the tick number."""
    own = ticks.where("dim = 'qps'").select(F.col("tick").alias("_at"), "p50", "p95", "p99", "n")
    at = (F.floor(F.col("ts") / every) * every).cast("long")
    return events.withColumn("_at", at).join(own, "_at", "left").withColumnRenamed("_at", "tick")


@dataclass(frozen=True)
class Preload:
    """What the preload learns: one row, so it is kept as values."""

    window_min: int
    buckets: int
    healthy: int
    confidence: float
    dims: dict[str, tuple[float, float, float, int]]


def lookback(buckets: DataFrame, minutes: int = 10, most: int = 240, target: int = 10) -> DataFrame:
    """One row (minutes, cutoff, median, healthy) for the first window that has enough healthy buckets or all buckets.

    At most 240 minutes, so at most 49 buckets a candidate.
    """
    ends = buckets.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    near = buckets.join(F.broadcast(ends), F.col("bucket") >= F.col("hi") - most * 60 - 1800)
    tries = near.withColumn("minutes", F.explode(F.sequence(F.lit(minutes), F.lit(most), F.lit(30)))).where(F.col("bucket") >= F.col("hi") - F.col("minutes") * 60)
    each = tries.groupBy("minutes").agg(F.array_sort(F.collect_list("total")).alias("v"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    med = F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).cast("double")
    each = each.withColumn("median", F.when(med <= 0, 1.0).otherwise(med)).withColumn("cutoff", F.col("hi") - F.col("minutes") * 60)
    each = each.withColumn("healthy", F.size(F.filter("v", lambda x: x >= F.col("median") * 0.5)).cast("long"))
    stop = (F.col("healthy") >= target) | (F.col("lo") >= F.col("cutoff"))
    pick = F.coalesce(F.min(F.when(stop, F.col("minutes"))), F.max("minutes"))
    chosen = each.agg(pick.alias("minutes"))
    return each.join(F.broadcast(chosen), "minutes").select(F.col("minutes").cast("long").alias("minutes"), "cutoff", "median", F.size("v").cast("long").alias("buckets"), "healthy")


def preload_samples(buckets: DataFrame) -> DataFrame:
    """dim, value of the healthy buckets within the lookback."""
    look = F.broadcast(lookback(buckets).select("cutoff", "median"))
    good = buckets.join(look, (F.col("bucket") >= F.col("cutoff")) & (F.col("total") >= F.col("median") * 0.5))
    t = F.col("total").cast("double")
    values = {"qps": t / 300, "r4xx": F.col("n4xx") / t, "r5xx": F.col("n5xx") / t, "r404": F.col("n404") / t, "auth": F.col("auth") / t}
    return good.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), v.alias("value")) for d, v in values.items()])).alias("x")).select("x.*")


def preload_percentiles(buckets: DataFrame) -> DataFrame:
    """Dim, p50, p95, p99, n: P99 trim on all, MAD trim on QPS only, QPS floored by itself."""
    keys = ["dim"]
    h = p99_trim(histogram(preload_samples(buckets), keys), keys)
    p = percentiles(mad_trim(h.where("dim = 'qps'"), keys).unionByName(h.where("dim != 'qps'")), keys)
    low = min_qps(F.col("p95"), F.col("n"))
    under = (F.col("dim") == "qps") & (F.col("p95") < low)
    f = lambda k, m: F.when(under, low * m).otherwise(F.col(k)).alias(k)
    return p.select("dim", f("p50", 0.3), f("p95", 1.0), f("p99", 2.0), "n")


def preload(buckets: DataFrame) -> Preload:
    look = lookback(buckets).first()
    if look is None:
        return Preload(0, 0, 0, 0.0, {})
    conf = min(1.0, look["healthy"] / look["buckets"]) * (0.5 if look["healthy"] < 10 else 1.0)
    dims = {r["dim"]: (r["p50"], r["p95"], r["p99"], r["n"]) for r in preload_percentiles(buckets).collect()}
    dims |= {d: (0.0, 1.0, 1.0, 0) for d in ("sens", "bot", "empty_ref")} | {"head": (0.0, 0.0, 0.0, 0)}
    return Preload(look["minutes"], look["buckets"], look["healthy"], conf, dims)


def ip_diversity(events: DataFrame) -> DataFrame:
    """Unique public addresses, the share of the top one and three, and whether they look like unmarked proxies."""
    per = events.where((F.col("source_ip") != "") & ~S.is_private(F.col("source_ip"))).groupBy("source_ip").agg(F.count("*").alias("n"))
    top = per.orderBy(F.desc("n"), "source_ip").limit(3).agg(F.max("n").alias("t1"), F.sum("n").alias("t3"))
    both = per.agg(F.count("*").alias("unique_ips"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).join(F.broadcast(top), F.lit(True), "left")
    top1, top3 = S.ratio(F.col("t1"), F.col("total")), S.ratio(F.col("t3"), F.col("total"))
    u = F.col("unique_ips")
    return both.select("unique_ips", top1.alias("top1_ratio"), top3.alias("top3_ratio"), proxy_suspected(u, top1, top3).alias("suspicious"))


def proxy_suspected(unique: Column, top1: Column, top3: Column) -> Column:
    return unique.between(1, 3) | (unique.between(4, 10) & ((top1 >= 0.90) | (top3 >= 0.98)))
