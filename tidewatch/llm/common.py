"""Helpers shared by the training-data operators.

Row identity. `doc_id` may be null or repeated, so operators key rows by the
pair (doc_id, xxhash64(text)); rows that agree on both are copies of each other
and always get equal results.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_code

#: Bytes of text that one step inside a task handles at once.
SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of an input folder, which may lie in any store that Spark reads."""
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, in local mode (tests) below a temporary folder, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back: cuts lineage, survives lost executors.

    The folder stays until the owner of spark.checkpoint.dir clears it.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text's hash and the text (null text becomes empty); other columns only if named."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("_th"), text.alias("text"), *more)


def same_doc(a: DataFrame, b: DataFrame):
    """Join condition on the row identity; nulls equal nulls."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_th"] == b["_th"])


def boxed(docs: DataFrame) -> DataFrame:
    """`row` (all columns as one struct, so that their names clash with nothing), doc_id, _th and text (null becomes empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text).alias("_th"), text.alias("text"))


def unboxed(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of `docs` out of `row`, with `text` in place of the text."""
    return rows.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


#: Bytes up to which a table of rows of any width is sent to all executors.
BROADCAST_BYTES = 32 << 20


def sendable(df: DataFrame, row_bytes: Column) -> DataFrame:
    """Mark a written table for broadcast if its rows, of `row_bytes` each, hold at most BROADCAST_BYTES; larger ones join by shuffle."""
    total = df.agg(F.sum(row_bytes).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over all output bits."""
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def mix_one(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes of text; one row is never cut."""
    sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
    if not len(sizes):
        return
    part = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def text_bytes(col: pa.Array, sep: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one uint8 array with their start and end offsets; `sep` puts that byte after each text."""
    col = col.fill_null("") if col.null_count else col
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if sep is None:
        return raw[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    n = len(col)
    out = np.full(int(offsets[-1] - offsets[0]) + n, sep, dtype=np.uint8)
    starts = offsets[:-1] - offsets[0] + np.arange(n)
    ends = offsets[1:] - offsets[0] + np.arange(n)
    at = offsets.tolist()
    for i, s in enumerate(starts.tolist()):
        out[s : s + at[i + 1] - at[i]] = raw[at[i] : at[i + 1]]
    return out, starts, ends


class Rolling:
    """Hashes of arbitrary spans of a byte array in constant time each.

    A span from s to e has the sum of table[byte] * base**(position - s), modulo the prime 2**31 - 1, for two bases and
    tables; both sums together are mixed with the span's length. Two given spans of n bytes that differ agree with a
    probability of at most (n / 2**31)**2 over the bases, whatever their bytes.
    """

    _prime = np.uint64((1 << 31) - 1)
    _bases = (0x3C6EF372, 0x1F83D9AB)
    _tables = tuple((mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(c)) >> np.uint64(34)) + np.uint64(1) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
    _powers: list[np.ndarray] = []
    _inverses: list[np.ndarray] = []

    @classmethod
    def _reduced(cls, x: np.ndarray) -> np.ndarray:
        """Congruent, below 2**33 for any x."""
        return (x & cls._prime) + (x >> np.uint64(31))

    @classmethod
    def powers(cls, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The first n powers of each base and of its inverse, at least."""
        if not cls._powers or len(cls._powers[0]) < n:
            p = int(cls._prime)

            def run(base: int) -> np.ndarray:
                out = np.ones(1, np.uint64)
                while len(out) < n:
                    out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % cls._prime])
                return out[:n]

            cls._powers, cls._inverses = [run(b) for b in cls._bases], [run(pow(b, -1, p)) for b in cls._bases]
        return cls._powers, cls._inverses

    def __init__(self, data: np.ndarray):
        powers, self.inverses = self.powers(max(len(data) + 1, SLICE_BYTES + 4096))
        self.sums = []
        for table, power in zip(self._tables, powers):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self._reduced(table[data] * power[: len(data)]), out=sums[1:])
            self.sums.append(sums)

    def spans(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        lanes = []
        for sums, inverse in zip(self.sums, self.inverses):
            x = self._reduced(self._reduced(self._reduced(self._reduced(sums[e] - sums[s])) * inverse[s]))
            lanes.append(np.where(x >= self._prime, x - self._prime, x))
        return mix((lanes[0] | lanes[1] << np.uint64(31)) ^ ((e - s).astype(np.uint64) * _M2))


WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs `[^\\x20\\x09-\\x0D]+` of bytes."""
    edge = np.diff(np.concatenate(([True], WHITE[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
