"""Keyed state in streams: confirmation with accepted blocks and traps (X1, X2), resource enumeration (W9) and port scans.

An event waits in its key's state until the watermark has passed it; then all that wait and are due are worked in order of
(ts, seq). So the result is that of the batch operators on the same rows however they are cut into micro-batches, late
rows within the watermark's delay among them; rows later than that are dropped by Spark. What waits is bounded by the
delay and the key's rate, and the rest of a key's state expires by timer: an observation after its time, a block with its
end, ids and ports with their windows.

The state store must be RocksDB (`with_store`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Confirm
from ..operators.confirm import meet, see
from .processor import LATENESS, timed

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> SparkSession:
    """Choose the state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Ordered(StatefulProcessor):
    """Works a key's rows in order of event time. Subclasses name the `columns` that wait (ts and seq first) and the `output`."""

    columns: str
    output: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.names = [c.split()[0] for c in self.columns.split(", ")]
        # pandas holds whole numbers beside nulls as doubles.
        kinds = {"long": int, "int": int, "boolean": bool, "string": str}
        self.kinds = [kinds[c.split()[1]] for c in self.columns.split(", ")]
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Open the states of the subclass."""

    def play(self, key: str, rows: list[tuple]) -> list[tuple]:
        """Work rows that are in order; the rows to put out."""
        raise NotImplementedError

    def expires(self, watermark: int) -> int | None:
        """Drop what has expired at `watermark` (seconds); the next second at which something will, if any."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(x) else kind(x) for kind, x in zip(self.kinds, r)) for part in rows for r in part[self.names].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] * 1000 <= now]
        out = self.play(key[0], due) if due else []
        if len(due) < len(rows):
            self.waiting.put(rows[len(due) :])
            self.handle.registerTimer(rows[len(due)][0] * 1000)
        else:
            self.waiting.clear()
        then = self.expires(now // 1000)
        if then is not None and then * 1000 > now:
            self.handle.registerTimer(then * 1000)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.output.split(", ")])

    def close(self) -> None:
        pass


class Confirming(Ordered):
    columns = "ts long, seq long, path string, sure boolean, trap boolean"
    output = "source_ip string, ts long, seq long, count long, accepted boolean"

    def __init__(self, c: Confirm, ttl: int | None):
        self.c, self.ttl = c, ttl

    def open(self, handle) -> None:
        self.observed = handle.getValueState("observed", "first long, last long, count long, path string")
        self.blocked = handle.getValueState("blocked", "until long")

    def play(self, key: str, rows: list[tuple]) -> list[tuple]:
        state = dict(zip(("first", "last", "count", "path"), self.observed.get())) if self.observed.exists() else None
        until, out = self.blocked.get()[0] if self.blocked.exists() else None, []
        for ts, seq, path, sure, trap in rows:
            state, until, count, accepted = meet(state, until, ts, path, bool(sure), bool(trap), self.c, self.ttl)
            if count is not None:
                out.append((key, ts, seq, count, accepted))
        if state:
            self.observed.update((state["first"], state["last"], state["count"], state["path"]))
        else:
            self.observed.clear()
        if until is not None:
            self.blocked.update((until,))
        return out

    def expires(self, watermark: int) -> int | None:
        ends = []
        if self.observed.exists():
            end = self.observed.get()[1] + self.c.observe + 1
            if end <= watermark:
                self.observed.clear()
            else:
                ends.append(end)
        if self.blocked.exists():
            end = self.blocked.get()[0]
            if end <= watermark:
                self.blocked.clear()
            else:
                ends.append(end)
        return min(ends, default=None)


class _Timed(Ordered):
    """State of one kind: name -> time, forgotten `span` seconds after that."""

    span: int

    def open(self, handle) -> None:
        self.known = handle.getMapState("known", "name string", "at long")

    def load(self) -> dict[str, int]:
        """In order of time."""
        return dict(sorted(((k[0], v[0]) for k, v in self.known.iterator()), key=lambda x: x[1])) if self.known.exists() else {}

    def store(self, old: dict[str, int], new: dict[str, int]) -> None:
        for k in old.keys() - new.keys():
            self.known.removeKey((k,))
        for k, t in new.items():
            if old.get(k) != t:
                self.known.updateValue((k,), (t,))

    def expires(self, watermark: int) -> int | None:
        old = self.load()
        new = {k: t for k, t in old.items() if t + self.span > watermark}
        self.store(old, new)
        return min((t + self.span for t in new.values()), default=None)


class Enumerating(_Timed):
    columns = "ts long, seq long, id string"
    output = "source_ip string, seq long, ids long, idor long"

    def __init__(self, window: int, most: int, weight: int):
        self.span, self.most, self.weight = window, most, 15 if weight < 0 else weight

    def play(self, key: str, rows: list[tuple]) -> list[tuple]:
        old, out = self.load(), []
        seen = dict(old)
        for ts, seq, ident in rows:
            see(seen, ident, ts, self.span)
            out.append((key, seq, len(seen), self.weight if len(seen) > self.most else 0))
        self.store(old, seen)
        return out


class Scanning(_Timed):
    columns = "ts long, seq long, dst_port int"

    def __init__(self, limits: Sequence[tuple[int, int]], weight: int):
        self.limits, self.weight, self.span = limits, weight, max(w for w, _ in limits)
        self.output = "src_ip string, ts long, seq long, dst_port int, " + "".join(f"ports_{w} long, " for w, _ in limits) + "score long"

    def open(self, handle) -> None:
        super().open(handle)
        self.told = handle.getValueState("told", "at long")

    def play(self, key: str, rows: list[tuple]) -> list[tuple]:
        if self.told.exists():
            return []
        old = self.load()
        last = dict(old)
        for ts, seq, port in rows:
            if port < 0:  # no port
                continue
            last[str(port)] = ts
            counts = [sum(t > ts - w for t in last.values()) for w, _ in self.limits]
            if any(n > most for n, (_, most) in zip(counts, self.limits)):
                self.told.update((ts,))
                self.store(old, {})
                return [(key, ts, seq, port, *counts, self.weight)]
            if len(last) > 2 * max(most for _, most in self.limits):
                last = {p: t for p, t in last.items() if t > ts - self.span}
        self.store(old, last)
        return []


def _run(rows: DataFrame, key: str, processor: Ordered, lateness: str) -> DataFrame:
    with_store(rows.sparkSession)
    return timed(rows, lateness).groupBy(key).transformWithStateInPandas(processor, processor.output, "Append", "EventTime")


def confirm_blocks(scored: DataFrame, c: Confirm = Confirm(), ttl: int | None = None, lateness: str = LATENESS) -> DataFrame:
    """Operators.confirm.confirm_blocks over a stream of the same rows."""
    trap = F.coalesce(F.col("honeypot"), F.lit(False)) if "honeypot" in scored.columns else F.lit(False)
    rows = scored.where("is_high").select("source_ip", "ts", "seq", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("high_confidence", F.lit(False)).alias("sure"), trap.alias("trap"))
    return _run(rows, "source_ip", Confirming(c, ttl), lateness)


def idor(events: DataFrame, path_regex: str, id_regex: str, window: int = 60, most: int = 20, weight: int = 15, lateness: str = LATENESS) -> DataFrame:
    """Operators.confirm.idor over a stream of the same rows."""
    ident: Column = F.regexp_extract("path", id_regex, 1)
    rows = events.where(F.col("path").rlike(path_regex)).select("source_ip", "ts", "seq", ident.alias("id")).where("id != ''")
    return _run(rows, "source_ip", Enumerating(window, most, weight), lateness)


def port_scans(ports: DataFrame, limits: Sequence[tuple[int, int]] = ((5, 5), (30, 15), (120, 40)), weight: int = 30, lateness: str = LATENESS) -> DataFrame:
    """Operators.windows.port_scans over a stream of the same rows; an address is told of once, at its first breach."""
    return _run(ports.select("src_ip", "ts", "seq", F.coalesce("dst_port", F.lit(-1)).alias("dst_port")), "src_ip", Scanning(limits, weight), lateness)
