"""Ordered per-address state: multi-event confirmation (X1, X2) and resource enumeration.

Both depend on the order of an address's events and cannot be written as a window frame. Events are
reduced to those that matter, split at idle gaps after which the state has expired anyway, and dealt by
(address, session), so an address that returns again and again is not one group. Within a group rows
stream in order through a sorted partition; a group is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Confirm
from .windows import sessions


def step(state: dict | None, ts: int, path: str, sure: bool, c: Confirm) -> tuple[dict | None, bool]:
    """One event scored high; the new state and whether to block."""
    if c.count <= 1 or sure or c.observe <= 0:
        return state, True
    if state is None or ts - state["last"] > c.observe and ts - state["first"] > c.observe:
        return {"first": ts, "last": ts, "count": 1, "path": path}, False
    if c.merge > 0 and ts - state["last"] <= c.merge and (path == state["path"] or ts == state["last"]):
        return state | {"last": ts}, False
    if ts - state["first"] > c.observe:
        return {"first": ts, "last": ts, "count": 1, "path": path}, False
    new = state | {"count": state["count"] + 1, "last": ts, "path": path}
    return new, new["count"] >= c.count


def meet(state: dict | None, until: int | None, ts: int, path: str, sure: bool, trapped: bool, c: Confirm, ttl: int | None) -> tuple[dict | None, int | None, int | None, bool]:
    """One event scored high or in a trap: the new observation, when the present block ends, the count if it asks for a block, and whether that is accepted.

    A trap asks at once and leaves the observation as it is; an accepted block of another event clears it (X2).
    """
    block = trapped
    if not trapped:
        state, block = step(state, ts, path, sure, c)
    if not block:
        return state, until, None, False
    count, accepted = state["count"] if state else 1, ttl is not None and (until is None or ts >= until)
    if accepted:
        until, state = ts + ttl, state if trapped else None
    return state, until, count, accepted


def see(seen: dict[str, int], ident: str, ts: int, window: int) -> None:
    """Take up an id; `seen` is id -> first time, in order of time, and loses what is `window` seconds old."""
    while seen and ts - (first := next(iter(seen.items())))[1] >= window:
        del seen[first[0]]
    seen.setdefault(ident, ts)


def confirm_blocks(scored: DataFrame, c: Confirm = Confirm(), ttl: int | None = None) -> DataFrame:
    """source_ip, ts, seq, count, accepted of every event that asks for a block, from rows (source_ip, ts, seq, path, is_high, high_confidence).

    With `ttl` an address is blocked for as many seconds by the first such event; later ones in that time are not
    accepted (X2: an accepted block clears the observation). Without it no block is accepted, so observations go on.
    Rows may have `honeypot`: such an event asks at once and leaves the observation as it is.
    """
    trap = F.coalesce(F.col("honeypot"), F.lit(False)) if "honeypot" in scored.columns else F.lit(False)
    high = sessions(scored.where("is_high"), idle=max(c.observe, ttl or 0) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, until = None, None, None
        for b in batches:
            out = []
            for ip, session, ts, seq, path, sure, trapped in zip(*(x.to_pylist() for x in b.columns)):
                if (ip, session) != key:
                    key, state, until = (ip, session), None, None
                state, until, count, accepted = meet(state, until, ts, path, sure, trapped, c, ttl)
                if count is not None:
                    out.append((ip, ts, seq, count, accepted))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.record_batch([pa.array(cols[0], pa.string()), *(pa.array(x, pa.int64()) for x in cols[1:4]), pa.array(cols[4], pa.bool_())], names=["source_ip", "ts", "seq", "count", "accepted"])

    rows = high.select("source_ip", "session", "ts", "seq", "path", "high_confidence", trap.alias("trap"))
    return rows.repartition("source_ip", "session").sortWithinPartitions("source_ip", "session", "ts", "seq").mapInArrow(run, "source_ip string, ts long, seq long, count long, accepted boolean")


def idor(events: DataFrame, path_regex: str, id_regex: str, window: int = 60, most: int = 20, weight: int = 15) -> DataFrame:
    """Seq, source_ip, ids, idor (weight) of events of an address beyond `most` distinct ids; an id expires `window` seconds after it was first seen."""
    ids = events.where(F.col("path").rlike(path_regex)).withColumn("id", F.regexp_extract("path", id_regex, 1)).where("id != ''")
    rows = sessions(ids.select("source_ip", "ts", "seq", "id"), idle=window)
    w = 15 if weight < 0 else weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, {}
        for b in batches:
            out = []
            for ip, session, ts, seq, ident in zip(*(b.column(n).to_pylist() for n in ("source_ip", "session", "ts", "seq", "id"))):
                if (ip, session) != key:
                    key, seen = (ip, session), {}
                see(seen, ident, ts, window)
                out.append((ip, seq, len(seen), w if len(seen) > most else 0))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.record_batch([pa.array(cols[0], pa.string()), *(pa.array(x, pa.int64()) for x in cols[1:])], names=["source_ip", "seq", "ids", "idor"])

    return rows.repartition("source_ip", "session").sortWithinPartitions("source_ip", "session", "ts", "seq").mapInArrow(run, "source_ip string, seq long, ids long, idor long")


def expired(observations: DataFrame, now: Column, observe: int = 30) -> DataFrame:
    """Observations (ip, last) that an eviction at `now` drops."""
    return observations.where(now - F.col("last") > observe)
