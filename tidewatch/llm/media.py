"""Media columns: 8-bit mono WAV media in content-defined chunks.

A record's media, its header included, is cut where a rolling gear hash of the last 32 bytes has its top bits
zero, so an insertion moves only the cuts near it. Chunk digests are counted by
Spark; a chunk that only one record has lies inline in that record's row, one that
several have is stored once in a shared table, and each record keeps the ordered
list of its chunks. Reading joins shared chunks back, puts each list in order,
verifies every digest and the header, and takes the payload out of the media.

To avoid moving media, a writer asks a Bloom filter of FILTER_BITS bits (a fixed
8 MiB whatever the input) whether a chunk may be shared. A false yes only stores a
chunk in the shared table that could have been inline.

Defined results: null text counts as empty; a payload is padded with zero bytes to
a positive multiple of 64; equal texts give equal values; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, slices

LEAST, MOST, TOP_BITS = 1024, 16384, 12
FILTER_BITS = 1 << 26
RATE = 8000
#: Bytes of a WAV header before the samples.
HEADER = 44
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the last 32 bytes at every position, by doubling the window five times."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cut(data: bytes) -> list[bytes]:
    """Chunks of one record's bytes: LEAST to MOST bytes, about 2**TOP_BITS beyond the least."""
    if len(data) <= LEAST:
        return [data]
    marks = np.flatnonzero(gear(np.frombuffer(data, np.uint8)) >> np.uint32(32 - TOP_BITS) == 0) + 1
    out, at = [], 0
    while at < len(data):
        k = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[k]) if k < len(marks) else len(data), at + MOST, len(data))
        out.append(data[at:end])
        at = end
    return out


def digest(chunk: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(chunk, digest_size=16).digest())


def _texts(batches) -> Iterator[tuple[int | None, int, list[bytes]]]:
    for batch in batches:
        for part in slices(batch):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                n, data = payload(text)
                yield doc, n, cut(wave(data))


def _batched(rows: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for weight, row in rows:
        held.append(row)
        size += weight
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def shared_filter(docs: DataFrame) -> bytes:
    """Bloom filter of the digests that occur more than once."""

    def run(batches):
        keys = pa.schema([("d1", pa.int64()), ("d2", pa.int64())])
        yield from _batched(((64, dict(zip(("d1", "d2"), digest(c)))) for _, _, chunks in _texts(batches) for c in chunks), keys)

    found = docs.select("doc_id", "text").mapInArrow(run, "d1 long, d2 long").groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1")
    at = found.select(F.explode(F.array("d1", "d2")).alias("d")).select(F.col("d").bitwiseAND(FILTER_BITS - 1).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 63 as int))")
    cells = at.groupBy((F.shiftright("p", 6)).alias("cell")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return out.tobytes()


def _maybe(bits: np.ndarray, d: tuple[int, int]) -> bool:
    return all(bits[(x & (FILTER_BITS - 1)) >> 6] >> np.int64(x & 63) & 1 for x in d)


CHUNK = pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])
STORED = "doc_id long, n_bytes long, m1 long, m2 long, chunks array<struct<d1:bigint,d2:bigint,length:bigint,data:binary>>"


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write the media rows and the shared chunks; returns both tables as read back."""
    spark = docs.sparkSession
    flags = spark.sparkContext.broadcast(shared_filter(docs))

    def inline(batches):
        bits = np.frombuffer(flags.value, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("m1", pa.int64()), ("m2", pa.int64()), ("chunks", pa.list_(CHUNK))])

        def rows():
            for doc, n, chunks in _texts(batches):
                ids = [digest(c) for c in chunks]
                m1, m2 = digest(b"".join(struct.pack("<qq", *d) for d in ids))
                yield sum(map(len, chunks)) + 64, {"doc_id": doc, "n_bytes": n, "m1": m1, "m2": m2, "chunks": [{"d1": d[0], "d2": d[1], "length": len(c), "data": None if _maybe(bits, d) else c} for d, c in zip(ids, chunks)]}

        yield from _batched(rows(), schema)

    def shared(batches):
        bits, seen = np.frombuffer(flags.value, np.int64), set()
        schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("data", pa.binary())])

        def rows():
            for _, _, chunks in _texts(batches):
                for c in chunks:
                    d = digest(c)
                    if d not in seen and _maybe(bits, d):
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(d)
                        yield len(c) + 64, {"d1": d[0], "d2": d[1], "data": c}

        yield from _batched(rows(), schema)

    texts = docs.select("doc_id", "text")
    return materialize(texts.mapInArrow(inline, STORED)), materialize(texts.mapInArrow(shared, "d1 long, d2 long, data binary").dropDuplicates(["d1", "d2"]))


def wave(data: bytes) -> bytes:
    """8-bit mono WAV media of the payload."""
    return b"RIFF" + struct.pack("<I", (36 + len(data)) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(data) & 0xFFFFFFFF) + data


def samples(media: bytes) -> bytes:
    """The payload of WAV media that `wave` has made."""
    data = media[HEADER:]
    if media[:HEADER] != wave(data)[:HEADER]:
        raise ValueError("the media's header does not fit its samples")
    return data


def feature(data: bytes) -> str:
    """Loudest and softest sample, their sum, energy around the middle and crossings of it."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    side = x >= 128
    return f"peak={x.max()} floor={x.min()} sum={x.sum()} energy={((x - 128) ** 2).sum()} crossings={int((side[1:] != side[:-1]).sum())} distinct={len(np.unique(x))}"


def _verified(chunks: list[dict]) -> bytes:
    for c in chunks:
        if c["data"] is None or len(c["data"]) != c["length"] or digest(c["data"]) != (c["d1"], c["d2"]):
            raise ValueError(f"a stored chunk does not match its digest ({c['d1']}, {c['d2']})")
    return b"".join(c["data"] for c in chunks)


VALUES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
VALUE_TYPES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_VALUE_SCHEMA = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _values(whole: DataFrame, keys: str) -> DataFrame:
    """`keys` (two longs) and VALUES of rows whose chunks all have their data."""
    names = [x.split()[0] for x in keys.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names] + _VALUE_SCHEMA)

    def run(batches):
        def rows():
            for batch in batches:
                for k in range(batch.num_rows):
                    media = _verified(batch.column("chunks")[k].as_py())
                    data = samples(media)
                    values = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(data))
                    yield 400, {n: batch.column(n)[k].as_py() for n in names} | dict(zip(VALUES, values))

        yield from _batched(rows(), schema)

    return whole.select(*names, "chunks").mapInArrow(run, f"{keys}, {VALUE_TYPES}")


def read(media: DataFrame, shared: DataFrame) -> DataFrame:
    """Rebuild, verify and describe every record's media.

    Records with inline chunks only are read where they lie. Of the others each distinct chunk list is
    rebuilt once by joins, and its values go to all records that have this list.
    """
    waits = F.exists("chunks", lambda c: c["data"].isNull())
    ready = _values(media.where(~waits), "doc_id long, n_bytes long")
    waiting = media.where(waits)
    lists = waiting.select("m1", "m2", "chunks").dropDuplicates(["m1", "m2"])
    parts = lists.select("m1", "m2", F.posexplode("chunks").alias("pos", "c")).select("m1", "m2", "pos", "c.*")
    found = parts.where("data is null").drop("data").join(shared, ["d1", "d2"], "left")
    columns = ["m1", "m2", "pos", "d1", "d2", "length", "data"]
    every = found.select(columns).unionByName(parts.where("data is not null").select(columns))
    whole = every.groupBy("m1", "m2").agg(F.array_sort(F.collect_list(F.struct("pos", "d1", "d2", "length", "data"))).alias("chunks"))
    values = _values(whole, "m1 long, m2 long")
    rest = waiting.select("doc_id", "n_bytes", "m1", "m2").join(values, ["m1", "m2"]).drop("m1", "m2")
    return ready.unionByName(rest)


def store_and_describe(docs: DataFrame) -> DataFrame:
    return read(*store(docs))
