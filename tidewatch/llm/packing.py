"""Best-fit packing planned on the histogram of lengths.

Best-fit-decreasing looks only at lengths, so the plan is made from the counts
per length (at most `capacity` rows) and never sees documents. A plan row says
that the documents ranked [rank_from, rank_to) among those of one length take
equal slots in a run of sequences. Documents get a rank within their length and
join the plan on it.

Defined results: null text counts as empty (one end id); repeated rows are packed
as often as they occur; rows with equal doc_id and text are interchangeable; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices
from .tokens import WhitespaceFreeEncoder, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "rank_from", "rank_to", "per_sequence", "sequence", "offset")])
#: Rows of one length that share a window partition when ranks are given, and the fewest groups of a length.
RANK_ROWS, RANK_GROUPS = 100_000, 64


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenize and cut what is longer than `capacity`: one row per piece."""

    def run(batches):
        enc, end = encoder(WhitespaceFreeEncoder, tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = memoryview(enc(text or "") + end)
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Best-fit decreasing over counts per length.

    Sequences with equal room form runs of consecutive numbers; a step fills whole runs, so its
    work follows the number of runs, not of documents. Rows: length, ranks from and to, documents
    per sequence, first sequence, offset of the first slot.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, how many)]
    rooms: list[int] = []
    rows, opened = [], 0

    def give_back(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first = capacity, opened
                many = -(-left // (capacity // length))
                opened += many
            each = room // length
            whole = min(many, left // each)
            if whole:
                rows.append((length, rank, rank + whole * each, each, first, capacity - room))
                rank, left = rank + whole * each, left - whole * each
                give_back(room - each * length, first, whole)
                first, many = first + whole, many - whole
            if many and left and left < each:  # the last few of this length share one sequence
                rows.append((length, rank, rank + left, left, first, capacity - room))
                give_back(room - left * length, first, 1)
                first, many, rank, left = first + 1, many - 1, rank + left, 0
            give_back(room, first, many)
    return rows


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to `pieces` (which need length and columns doc_id, piece to order by)."""
    spark = pieces.sparkSession
    # Ranks within a length: rows of a length are dealt over groups, each ranked on its own and shifted by the groups before it.
    total = pieces.count()
    groups = max(RANK_GROUPS, total // RANK_ROWS)
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = dealt.groupBy("length", "_g").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_g", F.coalesce("_before", F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("_at", at).join(before, ["length", "_g"]).withColumn("_rank", F.col("_at") + F.col("_before")).drop("_g", "_at", "_before")
    slots = spark.createDataFrame(plan(counts, capacity), PLAN).withColumnRenamed("length", "_length")
    on = (ranked["length"] == slots["_length"]) & (ranked["_rank"] >= slots["rank_from"]) & (ranked["_rank"] < slots["rank_to"])
    inside = F.col("_rank") - F.col("rank_from")
    return ranked.join(slots, on).select(
        *pieces.columns,
        (F.col("sequence") + F.floor(inside / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset") + (inside % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Tokenize, cut and pack whole documents. The pieces are written once, since the plan needs their counts first."""
    return pack(materialize(cut(docs, tokenizer, end_id, capacity)), capacity)
