"""Behaviour shape of an address's last events (C1-C9): one row per address, or as of each event. Ties between paths break by path."""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .windows import CHUNK, latest

# Paths that clients probe on their own, and extensions that never count as failing endpoints.
COMMON_PROBE = r"(?i)^/(favicon\.ico|robots\.txt|sitemap\.xml|crossdomain\.xml|\.well-known/.*)$"
STATIC_PATH = r"(?i)\.(css|js|mjs|png|jpe?g|gif|svg|ico|webp|woff2?|ttf|eot|otf|map)$"


@dataclass(frozen=True)
class Shape:
    """Thresholds, each of which may be overridden."""

    least: int = 20
    run: float = 3.0
    dominant: float = 0.5
    early: float = 0.70
    late: float = 0.40
    cover: float = 0.25
    cv: float = 0.6
    benign: int = 4


def _top(ring: DataFrame, k: int = 5) -> DataFrame:
    per = ring.groupBy("source_ip", "path").agg(F.count("*").alias("n"), F.min("status").alias("least"))
    w = Window.partitionBy("source_ip").orderBy(F.desc("n"), "path")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prefix_runs(ring: DataFrame) -> DataFrame:
    """Average run length of the first segment and the share of the commonest one."""
    w = Window.partitionBy("source_ip").orderBy("pos")
    seg = ring.withColumn("seg", S.first_segment(F.col("path")))
    new = F.when(F.col("seg") == F.lag("seg").over(w), 0).otherwise(1)
    runs = seg.withColumn("new", new)
    per = runs.groupBy("source_ip", "seg").agg(F.count("*").alias("n"), F.sum("new").alias("starts"))
    sums = per.groupBy("source_ip").agg(F.sum("n").alias("total"), F.sum("starts").alias("runs"), F.max("n").alias("most"))
    return sums.select("source_ip", (F.col("total") / F.col("runs")).alias("avg_run"), (F.col("most") / F.col("total")).alias("dominant"))


def novelty(ring: DataFrame) -> DataFrame:
    """Share of all paths met in the first third, and of the last third's events on paths not met there."""
    whole = Window.partitionBy("source_ip")
    k = F.greatest(F.floor(F.max("pos").over(whole) / 3), F.lit(1))
    rows = ring.withColumns({"k": k, "total": F.max("pos").over(whole)})
    per = rows.groupBy("source_ip", "path").agg(
        F.max(F.when(F.col("pos") <= F.col("k"), 1).otherwise(0)).alias("early"),
        F.count_if(F.col("pos") > F.col("total") - F.col("k")).alias("late"),
        F.first("k").alias("k"),
    )
    fresh = F.sum(F.when(F.col("early") == 0, F.col("late")).otherwise(0))
    return per.groupBy("source_ip").agg((F.sum("early") / F.count("*")).alias("early"), (fresh / F.first("k")).alias("late"))


def top_cover(ring: DataFrame) -> DataFrame:
    """Share of the events on the five commonest paths."""
    n = ring.groupBy("source_ip").agg(F.count("*").alias("total"))
    return _top(ring).groupBy("source_ip").agg(F.sum("n").alias("s")).join(n, "source_ip").select("source_ip", (F.col("s") / F.col("total")).alias("cover"))


def status_cv(ring: DataFrame) -> DataFrame:
    """C4: mean over paths with three events or more of the variation of their status counts, three decimals; 0 without such a path."""
    per = ring.groupBy("source_ip", "path", "status").agg(F.count("*").alias("n"))
    path = per.groupBy("source_ip", "path").agg(F.sum("n").alias("n"), F.coalesce(F.stddev_samp("n") / F.avg("n"), F.lit(0.0)).alias("cv"))
    ips = ring.select("source_ip").distinct()
    means = path.where("n >= 3").groupBy("source_ip").agg(F.round(F.avg("cv"), 3).alias("cv"))
    return ips.join(means, "source_ip", "left").select("source_ip", F.coalesce("cv", F.lit(0.0)).alias("cv"))


def method_mix(ring: DataFrame) -> DataFrame:
    """Shares of GET, POST and unusual methods, and whether they look like a client."""
    code = S.method_code(F.col("method"))
    share = lambda *m: F.avg(F.when(code.isin(*m), 1.0).otherwise(0.0))
    r = ring.groupBy("source_ip").agg(share("G").alias("get"), share("P").alias("post"), share("U", "D", "O", "H", "X").alias("unusual"))
    get, post, odd = F.col("get"), F.col("post"), F.col("unusual")
    fits = (get.between(0.5, 0.99) & post.between(0.01, 0.49) & (odd < 0.05)) | ((get >= 0.8) & (odd < 0.01)) | ((post >= 0.5) & (get > 0.01) & (odd < 0.05))
    return r.withColumn("method_ok", fits)


def always_error(ring: DataFrame) -> DataFrame:
    """Some top path, not static, with enough events that all failed (threshold 10 for common probes, else 5)."""
    bare = S.without_query(F.col("path"))
    probe = bare.rlike(COMMON_PROBE)
    hit = (probe | ~bare.rlike(STATIC_PATH)) & (F.col("n") >= F.when(probe, 10).otherwise(5)) & (F.col("least") >= 400)
    return _top(ring).groupBy("source_ip").agg(F.bool_or(hit).alias("always_error"))


def verdict(c: dict[str, Column], t: Shape) -> Column:
    """The weighted score; C7 (paths ever new, none common) counts against."""
    one = lambda cond, n: F.when(cond, n).otherwise(0)
    divergent = (c["early"] < 0.5) & (c["late"] > 0.7) & (c["cover"] < 0.4)
    return (
        one((c["avg_run"] >= t.run) | (c["dominant"] >= t.dominant), 2)
        + one((c["early"] >= t.early) & (c["late"] <= t.late), 2)
        + one(c["cover"] >= t.cover, 2)
        + one(c["cv"] < t.cv, 1)
        + one(c["method_ok"], 1)
        - one(c["always_error"], 5)
        - one(c["always_error"] & (c["n_paths"] < 3), 3)
        - one(divergent, 3)
    )


def consistency(events: DataFrame, t: Shape = Shape(), keep: int = 512) -> DataFrame:
    """source_ip, total, has_samples, score, is_benign and the parts, over the last `keep` events."""
    ring = latest(events, keep)
    base = ring.groupBy("source_ip").agg(F.count("*").alias("total"), F.count_distinct("path").alias("n_paths"))
    out = base
    for part in (prefix_runs(ring), novelty(ring), top_cover(ring), status_cv(ring), method_mix(ring), always_error(ring)):
        out = out.join(part, "source_ip")
    names = ("avg_run", "dominant", "early", "late", "cover", "cv", "method_ok", "always_error", "n_paths")
    out = out.withColumn("has_samples", F.col("total") >= t.least).withColumn("score", verdict({n: F.col(n) for n in names}, t).cast("long"))
    return out.withColumn("is_benign", F.col("has_samples") & (F.col("score") >= t.benign))


class Recent:
    """The shape of a sliding window of events, kept up to date event by event.

    Events are (first segment, path, status, method code, whether the path is a probe, whether it is static). Counts of
    what the window holds change by one step as an event comes or goes; the early and late thirds are two windows more.
    """

    def __init__(self, keep: int):
        self.keep, self.ring = keep, deque()
        self.segs, self.paths, self.fine, self.methods, self.runs = Counter(), Counter(), Counter(), Counter(), 0
        self.status: dict[str, Counter] = defaultdict(Counter)
        self.early, self.late, self.fresh = Counter(), Counter(), 0
        self.split, self.tail = 0, 0  # events in the early third; events before the late third

    def _count(self, counter: Counter, key: object, by: int) -> None:
        counter[key] += by
        if not counter[key]:
            del counter[key]

    def _in_early(self, path: str, by: int) -> None:
        known = path in self.early
        self._count(self.early, path, by)
        if known != (path in self.early):
            self.fresh += self.late[path] if known else -self.late[path]

    def _in_late(self, path: str, by: int) -> None:
        self._count(self.late, path, by)
        if path not in self.early:
            self.fresh += by

    def _change(self, event: tuple, by: int) -> None:
        seg, path, status, method, _, _ = event
        self._count(self.segs, seg, by)
        self._count(self.paths, path, by)
        self._count(self.methods, method, by)
        self._count(self.status[path], status, by)
        if not self.status[path]:
            del self.status[path]
        if status is not None and status < 400:
            self._count(self.fine, path, by)

    def add(self, event: tuple) -> None:
        ring = self.ring
        if len(ring) == self.keep:
            old = ring.popleft()
            self._change(old, -1)
            # The run of the oldest event goes on without it, unless the next one began another.
            self.runs -= ring[0][0] != old[0] if ring else 1
            if self.split:
                self._in_early(old[1], -1)
                self.split -= 1
            if self.tail:
                self.tail -= 1
            else:
                self._in_late(old[1], -1)
        self.runs += not ring or ring[-1][0] != event[0]
        ring.append(event)
        self._change(event, 1)
        self._in_late(event[1], 1)
        k = max(len(ring) // 3, 1)
        while self.split < k:
            self._in_early(ring[self.split][1], 1)
            self.split += 1
        while self.tail < len(ring) - k:
            self._in_late(ring[self.tail][1], -1)
            self.tail += 1

    def benign(self, t: Shape) -> tuple[int, int, bool]:
        """C1-C8 for the window as it is: events, score, verdict."""
        total = len(self.ring)
        k = max(total // 3, 1)
        top = nsmallest(5, self.paths.items(), key=lambda x: (-x[1], x[0]))
        cvs = [_spread(list(s.values())) for p, s in self.status.items() if self.paths[p] >= 3]
        cv = round(math.fsum(cvs) / len(cvs), 3) if cvs else 0.0
        get, post = self.methods["G"] / total, self.methods["P"] / total
        odd = sum(self.methods[m] for m in "UDOHX") / total
        fits = (0.5 <= get <= 0.99 and 0.01 <= post <= 0.49 and odd < 0.05) or (get >= 0.8 and odd < 0.01) or (post >= 0.5 and get > 0.01 and odd < 0.05)
        early, late, cover = len(self.early) / len(self.paths), self.fresh / k, sum(n for _, n in top) / total
        kind = {e[1]: (e[4], e[5]) for e in self.ring} if any(p not in self.fine for p, _ in top) else {}
        fails = any(p not in self.fine and (kind[p][0] or not kind[p][1]) and n >= (10 if kind[p][0] else 5) and all(x is not None for x in self.status[p]) for p, n in top)
        divergent = early < 0.5 and late > 0.7 and cover < 0.4
        score = 2 * (total / self.runs >= t.run or max(self.segs.values()) / total >= t.dominant) + 2 * (early >= t.early and late <= t.late)
        score += 2 * (cover >= t.cover) + (cv < t.cv) + fits - 5 * fails - 3 * (fails and len(self.paths) < 3) - 3 * divergent
        return total, score, total >= t.least and score >= t.benign


def _spread(counts: list[int]) -> float:
    """Sample deviation over mean; 0 for one number."""
    if len(counts) < 2:
        return 0.0
    mean = sum(counts) / len(counts)
    return math.sqrt(sum((x - mean) ** 2 for x in counts) / (len(counts) - 1)) / mean


#: Events of an address that stream through one piece, beside the context copied before them.
PIECE = 8192


def numbered(events: DataFrame, key: str = "source_ip") -> DataFrame:
    """Add _pos, each event's place (from 0) among the key's events, without a window over all events of a key.

    Places are counted per (key, chunk of time); a small table of one row per such pair carries the earlier chunks' sizes.
    """
    rows = events.withColumn("_t", F.floor(F.col("ts") / CHUNK))
    sizes = rows.groupBy(F.col(key).alias("_k"), F.col("_t").alias("_u")).agg(F.count("*").alias("_n"))
    before = sizes.select("_k", "_u", (F.sum("_n").over(Window.partitionBy("_k").orderBy("_u")) - F.col("_n")).alias("_b"))
    place = F.row_number().over(Window.partitionBy(key, "_t").orderBy("ts", "seq")) - 1
    joined = rows.join(before, F.col(key).eqNullSafe(F.col("_k")) & F.col("_t").eqNullSafe(F.col("_u")), "left")
    return joined.withColumn("_pos", (F.col("_b") + place).cast("long")).drop("_k", "_u", "_b", "_t")


def as_of(events: DataFrame, t: Shape = Shape(), keep: int = 512, asked: Column | None = None) -> DataFrame:
    """K3: seq, total, score, is_benign as of each event (those that are `asked`), over the address's last `keep` events.

    `seq` must be unique. An address's events are cut into pieces by their place, and the keep - 1 events before a piece
    are copied into it; within a piece the shape slides, so later events change no earlier verdict, and an address with a
    third of all events is as many pieces as it needs. No events give no rows.
    """
    bare = S.without_query(F.col("path"))
    rows = numbered(events.select("seq", "ts", "source_ip", F.coalesce("path", F.lit("")).alias("path"), "status", "method", (asked if asked is not None else F.lit(True)).alias("_ask")))
    size = max(PIECE, keep)
    piece = F.floor(F.col("_pos") / size)
    both = F.when(F.col("_pos") % size >= size - keep + 1, F.array(piece, piece + 1)).otherwise(F.array(piece))
    rows = rows.withColumn("_piece", F.explode(both)).withColumn("_ask", F.coalesce("_ask", F.lit(False)) & (F.col("_piece") == piece))
    rows = rows.select("source_ip", "_piece", "_pos", "seq", "_ask", S.first_segment(F.col("path")).alias("seg"), "path", "status", S.method_code(F.col("method")).alias("method"), bare.rlike(COMMON_PROBE).alias("probe"), bare.rlike(STATIC_PATH).alias("static"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, recent = None, None
        for batch in batches:
            out = []
            for ip, p, _, seq, ask, *event in zip(*(x.to_pylist() for x in batch.columns)):
                if (ip, p) != of:
                    of, recent = (ip, p), Recent(keep)
                recent.add(tuple(event))
                if ask:
                    out.append((seq, *recent.benign(t)))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.record_batch([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.bool_())], names=["seq", "total", "score", "is_benign"])

    dealt = rows.repartition("source_ip", "_piece").sortWithinPartitions("source_ip", "_piece", "_pos")
    return dealt.mapInArrow(run, "seq long, total long, score long, is_benign boolean")
