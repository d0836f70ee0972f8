"""Token-id output in bit-plane shuffled blocks.

Ids are written in ascending doc_id order (null ids first, ties by text). A stored
row is a chunk: whole documents, cut into blocks of BLOCK ids. Each block's ids are
transposed into four byte planes (optionally 32 bit planes), each plane of all
blocks of the chunk is compressed with zstandard, and the row's index gives the
documents, their lengths and the place in the shard. Shards follow the order of
doc_id, so the global place of an id is the shard's place plus its place inside.

Defined results: null text counts as empty (only the end id); repeated rows are
written as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir, shuffle_partitions, slices
from .tokens import SpaceLedEncoder, encoder

#: Ids in a transposed block, and ids after which a chunk is closed.
BLOCK, CHUNK_IDS = 4096, 1 << 18
STORED = "shard int, chunk int, first long, n_ids long, kind string, planes array<binary>, docs array<struct<doc_id:bigint,n:bigint>>"


def shuffle_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of the ids: plane p of every block, one after another. `kind`: byte or bit."""
    blocks = np.zeros((-(-len(ids) // BLOCK), BLOCK), "<u4")
    blocks.reshape(-1)[: len(ids)] = ids
    cells = blocks.view(np.uint8).reshape(len(blocks), BLOCK, 4).transpose(2, 0, 1)  # byte, block, id
    if kind == "byte":
        return [np.ascontiguousarray(x).tobytes() for x in cells]
    return [np.packbits((x >> np.uint8(b)) & np.uint8(1), axis=-1).tobytes() for x in cells for b in range(8)]


def unshuffle_planes(planes: list[bytes], n_ids: int, kind: str) -> np.ndarray:
    count = -(-n_ids // BLOCK)
    if kind == "bit":
        bits = [np.unpackbits(np.frombuffer(p, np.uint8).reshape(count, BLOCK // 8), axis=-1) for p in planes]
        planes = [sum(bits[8 * k + b] << np.uint8(b) for b in range(8)) for k in range(4)]
    cells = np.stack([np.frombuffer(p, np.uint8).reshape(count, BLOCK) if isinstance(p, bytes) else p for p in planes], axis=-1)
    return np.ascontiguousarray(cells).view("<u4").reshape(-1)[:n_ids]


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, kind: str = "byte", level: int = 3) -> None:
    """Encode every document, append `end_id` and store all ids at `path`."""

    def run(batches):
        import zstandard

        enc, end, pack = encoder(SpaceLedEncoder, tokenizer), np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=level)
        shard, chunk, first, held, size, index = TaskContext.get().partitionId(), 0, 0, [], 0, []

        def stored() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            planes = [pack.compress(p) for p in shuffle_planes(ids, kind)]
            row = {"shard": shard, "chunk": chunk, "first": first, "n_ids": len(ids), "kind": kind, "planes": planes, "docs": index}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = enc(text or "") + end
                    held.append(ids)
                    index.append({"doc_id": doc, "n": len(ids) // 4})
                    size += len(ids) // 4
                    if size >= CHUNK_IDS:
                        yield stored()
                        chunk, first, held, size, index = chunk + 1, first + size, [], 0, []
        if held:
            yield stored()

    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("kind", pa.string()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64())])))])
    rows = docs.select("doc_id", "text")
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, STORED).write.option("compression", "none").parquet(path)


def chunks(stored: DataFrame) -> DataFrame:
    """Every chunk with `start`, the number of ids stored before it."""
    sizes = stored.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = sizes.select("shard", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return stored.join(before, "shard").withColumn("start", F.col("_before") + F.col("first")).drop("_before")


def unpack(row_planes: list[bytes], n_ids: int, kind: str) -> np.ndarray:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return unshuffle_planes([d.decompress(p) for p in row_planes], n_ids, kind)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, bytes]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
            ids, at = unpack(row["planes"], row["n_ids"], row["kind"]), 0
            for d in row["docs"]:
                yield row["start"] + at, d["doc_id"], ids[at : at + d["n"]].tobytes()
                at += d["n"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids of every document, from the stored planes."""

    def run(batches):
        for start, doc, ids in _documents(batches):
            yield pa.RecordBatch.from_pylist([{"doc_id": doc, "start": start, "ids": np.frombuffer(ids, "<u4").astype(np.int64)}], schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return chunks(spark.read.parquet(path)).mapInArrow(run, "doc_id long, start long, ids array<bigint>")


def check(spark: SparkSession, path: str) -> DataFrame:
    """Read everything back: doc_id, start, n_tokens and the crc32 of the ids, per document."""

    def run(batches):
        rows = []
        for start, doc, ids in _documents(batches):
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
            if len(rows) == 10_000:
                yield batch(rows)
                rows = []
        yield batch(rows)

    def batch(rows):
        cols = list(zip(*rows)) if rows else [()] * 4
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return chunks(spark.read.parquet(path)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_check(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    path = scratch_dir(docs.sparkSession)
    write(docs, tokenizer, path, end_id)
    return check(docs.sparkSession, path)
