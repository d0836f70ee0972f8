"""Sharding by sampled splitters.

Records get a 64-bit key in which equal texts are neighbours. A size-weighted
sample of keys gives quantile boundaries of many small ranges; the bytes of each
range are then counted exactly, overfull ranges are subdivided by further samples
inside them, and runs of ranges become shards. Last, single ranges move from the
fullest to the emptiest shard while that evens sizes out.

Defined results: null text has size 1 and the checksum of no bytes; repeated rows
are separate records; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Ranges for each shard, keys sampled for each range, rows that a range should have at most, and the most ranges.
RANGES, SAMPLES, RANGE_ROWS, MOST_RANGES = 64, 16, 100_000, 1 << 16


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key: 40 bits of the text, 16 of doc_id, 8 that tell repeated rows apart."""
    text = F.col("text").cast("string")
    part = lambda h, bits: F.shiftrightunsigned(h, 64 - bits)
    row = F.monotonically_increasing_id()
    key = F.shiftleft(part(F.xxhash64(text), 39), 24) + F.shiftleft(part(F.xxhash64("doc_id"), 16), 8) + part(F.xxhash64(row), 8)
    none = F.lit("")
    return docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, none)).alias("text_crc32"), key.alias("_key"))


def _ranged(rows: DataFrame, bounds: np.ndarray, **per_range: np.ndarray) -> DataFrame:
    """Add _range, the number of bounds not above the key, and what `per_range` has for it."""
    names = list(per_range)

    def run(batches):
        for b in batches:
            r = np.searchsorted(bounds, np.asarray(b.column("_key")), "right")
            yield pa.record_batch([*b.columns, pa.array(r.astype(np.int64)), *(pa.array(per_range[n][r].astype(np.int64)) for n in names)], names=[*b.schema.names, "_range", *names])

    extra = "".join(f", {n} long" for n in ["_range", *names])
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + extra)


def _sample(rows: DataFrame, per_byte) -> np.ndarray:
    """Keys of a size-weighted sample: each row with probability size x per_byte."""
    u = F.shiftrightunsigned(F.xxhash64("_key", "doc_id", F.lit("sample")), 11) / F.lit(float(1 << 53))
    got = rows.where(u < F.col("size") * per_byte).select("_key").toPandas()["_key"]
    return np.sort(got.to_numpy(np.int64))


def _totals(rows: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, many = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for r in _ranged(rows, bounds).groupBy("_range").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect():
        size[r["_range"]], many[r["_range"]] = r["s"], r["n"]
    return size, many


def splitters(rows: DataFrame, shards: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries of ranges, and the exact bytes and rows of each."""
    total, many = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(MOST_RANGES, max(RANGES * shards, many // RANGE_ROWS))
    bounds = np.unique(_sample(rows, F.lit(SAMPLES * ranges / max(total, 1)))[SAMPLES - 1 :: SAMPLES])
    size, n = _totals(rows, bounds)
    for _ in range(rounds):
        over = (size > 2 * total / ranges) & (n > 1)
        if not over.any():
            break
        rate = np.where(over, np.round(SAMPLES * size / (total / ranges)), 0)
        inside = _ranged(rows, bounds, _rate=rate, _all=size).where("_rate > 0")
        more = np.union1d(bounds, _sample(inside, F.col("_rate") / F.col("_all")))
        if len(more) == len(bounds):
            break
        bounds = more
        size, n = _totals(rows, bounds)
    return bounds, size, n


def deal(size: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each range: runs of ranges with nearly equal bytes, then single ranges from the fullest to the emptiest."""
    middle = np.cumsum(size) - size / 2
    shard = np.minimum((middle * shards / max(size.sum(), 1)).astype(np.int64), shards - 1)
    load = np.bincount(shard, weights=size, minlength=shards)
    for _ in range(16 * shards):
        a, b = int(load.argmax()), int(load.argmin())
        own = np.flatnonzero((shard == a) & (size > 0))
        gap = load[a] - load[b]
        own = own[size[own] < gap]
        if not len(own):
            break
        r = own[np.abs(size[own] - gap / 2).argmin()]
        shard[r] = b
        load[a] -= size[r]
        load[b] += size[r]
    return shard


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law `bytes`."""
    rows = materialize(records(docs))
    bounds, size, many = splitters(rows, shards)
    shard = deal(size, shards)
    before = np.zeros(len(size), np.int64)
    for k in range(shards):
        own = np.flatnonzero(shard == k)
        before[own] = np.cumsum(many[own]) - many[own]
    w = Window.partitionBy("_range").orderBy("_key", "doc_id", "text_crc32")
    return _ranged(rows, bounds, _shard=shard, _before=before).select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_before") + F.row_number().over(w) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
