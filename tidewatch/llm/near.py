"""Near-duplicate documents by DartMinHash and banded joins.

A document is the weighted set of its five-word shingles. Throwing darts at random
onto the plane of (element weight, rank) and keeping, for each of K coordinates, the
dart of lowest rank gives a weighted MinHash signature. The darts of an element
depend on the element alone, and only darts below a rank of about (K ln K + 2K) /
weight are generated, so a signature costs K log K darts and not K per shingle; a
document with a coordinate left empty takes the next rank level.

Signatures are cut into BANDS bands of ROWS coordinates. Documents that share a
band are candidates: each is compared with the least and the greatest document of
its bucket and with the bucket's hub (the one that meets the most others), and then
with those of its bucket that no verified link has joined to it and whose similarity
can reach the threshold at all. Two exact bounds tell: shingles that no other open
document has cannot be shared, and parity sketches of two sets differ in no more bits
than the sets do in shingles. So a large group costs a few comparisons a member. Each
candidate pair is verified on its shingle sets (32-bit hashes; two different shingles of a pair of 500-shingle
documents fall together once in 17,000 pairs). At a similarity of 0.8 a pair shares
no band with a probability of 7 in a million.

Equal texts are one node from the start, so copies are never compared.

Defined results: null text counts as empty; words are runs of non-white-space
bytes, ASCII case folded; a text of one to four words is one shingle; texts without
words equal only texts of the same bytes; rows that agree in doc_id and text are
copies of each other, of which `keep_one` keeps one; an empty table gives an empty
result; `keep_one` carries all other columns, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, boxed, materialize, mix, slices, text_bytes, unboxed, words
from .graph import components, open_members, open_pairs, small, star_pairs, with_hub

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 30, 5
#: Words of 64 bits in a parity sketch.
SKETCH = 16
#: Rank cells: [0, 2**FIRST), then doubling; a cell longer than 1 is cut into unit cells. Weights are whole numbers, met unit by unit.
FIRST, LAST = -5, 14
_K = BANDS * ROWS
_DARTS = _K * math.log(_K) + 2 * _K
_G = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Document and hash of every shingle of a column of texts, and the number of texts."""
    data, starts, ends = text_bytes(col, sep=0x20)
    data = LOWER[data]
    ws, we = words(data)
    h, doc = Rolling(data).spans(ws, we), np.searchsorted(starts, ws, "right") - 1
    n = np.bincount(doc, minlength=len(starts))
    first = np.cumsum(n) - n

    def chain(at: np.ndarray, length: int) -> np.ndarray:
        out = np.full(len(at), length, np.uint64)
        for j in range(length):
            out = mix(out * _G + h[at + j])
        return out

    at = np.flatnonzero(doc[SHINGLE - 1 :] == doc[: len(doc) - SHINGLE + 1]) if len(doc) >= SHINGLE else np.zeros(0, np.int64)
    docs, hashes = [doc[at]], [chain(at, SHINGLE)]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n == k)
        docs.append(short)
        hashes.append(chain(first[short], k))
    return np.concatenate(docs), np.concatenate(hashes), len(starts)


def _poisson(mean: float) -> np.ndarray:
    p, total, out = math.exp(-mean), 0.0, []
    for k in range(24):
        total += p
        out.append(total)
        p *= mean / (k + 1)
    return np.array(out)


def _cells(level: int) -> list[tuple[float, float, int]]:
    """Rank cells (from, length, number) that level `level` adds."""
    if level == FIRST:
        return [(0.0, 2.0**FIRST, 0)]
    low = 2.0 ** (level - 1)
    if low <= 1:
        return [(low, low, level - FIRST)]
    return [(low + k, 1.0, (level - FIRST) * 100_003 + k) for k in range(int(low))]


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x K signatures of the weighted sets (doc, element, whole weight); rows of empty sets hold the largest number.

    An entry packs the rank of the earliest dart (high half) and its mark (low half).
    """
    if (weight > 1).any():  # unit w of an element has darts of its own, so heavier elements have more
        unit = np.concatenate([np.arange(w) for w in weight.tolist()]) if len(weight) else weight
        rows = np.repeat(np.arange(len(doc)), weight)
        doc, element = doc[rows], mix(element[rows] + unit.astype(np.uint64) * _G * (unit > 0))
    out = np.full(n * _K, _EMPTY)
    total = np.bincount(doc, minlength=n)
    want = np.ceil(np.log2(_DARTS / np.maximum(total, 1))).astype(np.int64)
    level_of = np.where(total > 0, np.clip(want, FIRST, LAST), FIRST - 1)
    todo = total > 0
    level = FIRST
    while todo.any():
        use = np.flatnonzero(todo[doc])
        d, x = doc[use], element[use]
        for low, length, number in _cells(level):
            seed = mix(x ^ np.uint64((number * int(_G) + 1) & 0xFFFFFFFFFFFFFFFF))
            u = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
            for k, below in enumerate(_poisson(length)):
                hit = np.flatnonzero(u >= below)
                if not len(hit):
                    break
                v = mix(seed[hit] + np.uint64((k + 1) * int(_G) & 0xFFFFFFFFFFFFFFFF))
                rank = low + (v >> np.uint64(40)).astype(np.float64) * 2.0**-24 * length
                packed = ((rank * 2.0**17).astype(np.uint64) << np.uint64(32)) | (mix(v + _G) >> np.uint64(32))
                np.minimum.at(out, d[hit] * _K + (v & np.uint64(0xFFFFFFFF)).astype(np.int64) % _K, packed)
        done = level_of <= level
        if level >= FIRST and done.any():
            full = (out.reshape(n, _K) != _EMPTY).all(1)
            todo &= ~(done & (full | (level >= LAST)))
        level += 1
    return out.reshape(n, _K)


def buckets(signature: np.ndarray) -> np.ndarray:
    """n x BANDS bucket numbers."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _G, parts.shape[:2]).copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(3) + parts[:, :, r])
    return h


def with_node(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns and `node`, two hashes of the text that stand for all its copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*columns, F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")).alias("node"), text.alias("_text"))


def members(nodes: DataFrame) -> DataFrame:
    """bucket, node, low, high for the buckets that hold more than one text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                doc, element, n = shingles(part.column("_text"))
                sig = dart_minhash(doc, element, np.ones(len(doc), np.int64), n)
                some = np.flatnonzero((sig != _EMPTY).any(1))
                b = buckets(sig[some]).reshape(-1)
                yield pa.record_batch([pa.array(b.view(np.int64)), part.column("node").take(pa.array(np.repeat(some, BANDS)))], names=["bucket", "node"])

    banded = nodes.select("node", "_text").mapInArrow(run, "bucket long, node struct<h1:bigint,h2:bigint>")
    ends = materialize(banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high"))
    return materialize(banded.join(small(ends), "bucket").distinct())


NODE = "struct<h1:bigint,h2:bigint>"


def shingle_sets(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, set (sorted 32-bit hashes) of the texts that `wanted` (node) names, written."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                doc, element, n = shingles(part.column("_text"))
                key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | (element >> np.uint64(32)))
                at = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
                low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                yield pa.record_batch([part.column("node"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(low))], names=["node", "set"])

    of = nodes.join(small(materialize(wanted)), "node", "left_semi").select("node", "_text").mapInArrow(run, f"node {NODE}, set array<int>")
    return materialize(of.dropDuplicates(["node"]))


def verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least `threshold`, written.

    The sets of a pair stay inside Spark: Arrow batches of pairs would hold two sets in each of their rows, on both sides.
    """
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    close = shared * (1 + threshold) >= threshold * (F.size("sa") + F.size("sb")) - 1e-9
    return materialize(pairs.join(a, "a").join(b, "b").where(close).select("a", "b"))


def shareable(sets: DataFrame) -> DataFrame:
    """node, n (shingles) and s (shingles that some other of these sets has too)."""
    lone = sets.select(F.explode("set").alias("t"), "node").groupBy("t").agg(F.count("*").alias("k"), F.max("node").alias("node")).where("k = 1")
    lone = lone.groupBy("node").agg(F.count("*").alias("u"))
    n = F.size("set").cast("long")
    return sets.join(lone, "node", "left").select("node", n.alias("n"), (n - F.coalesce("u", F.lit(0))).alias("s"))


def sketches(sets: DataFrame) -> DataFrame:
    """node and a parity sketch of 64 x SKETCH bits: each shingle flips one bit, so two sketches differ in no more bits than the sets in shingles."""

    def run(batches):
        for batch in batches:
            flips = np.zeros((batch.num_rows, 64 * SKETCH), np.uint8)
            sets = batch.column("set")
            marks, ends = sets.flatten().to_numpy().view(np.uint32) % np.uint32(64 * SKETCH), np.cumsum(pc.list_value_length(sets).to_numpy())
            for k, (s, e) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                flips[k] = np.bincount(marks[s:e], minlength=64 * SKETCH) & 1
            bits = np.packbits(flips, axis=1).view(np.int64)
            yield pa.record_batch([batch.column("node"), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH))], names=["node", *(f"p{k}" for k in range(SKETCH))])

    return sets.mapInArrow(run, f"node {NODE}, " + ", ".join(f"p{k} long" for k in range(SKETCH)))


def labels(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, label for the texts that are similar to another text."""
    nodes = with_node(docs)
    found = materialize(with_hub(members(nodes)))
    stars = materialize(star_pairs(found, "low", "high", "hub"))
    links = verified(shingle_sets(nodes, stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()), stars, threshold)
    first = components(links)
    still = materialize(open_members(found.select("bucket", "node"), first, met=3))
    if still.isEmpty():
        return first
    sets = shingle_sets(nodes, still.select("node").distinct())
    bounded = shareable(sets).where(F.col("s") >= threshold * F.col("n") - 1e-9)
    still = materialize(still.join(bounded, "node").join(sketches(sets), "node"))
    most, both = F.least("l.s", "r.s"), F.col("l.n") + F.col("r.n")
    apart = sum((F.bit_count(F.col(f"l.p{k}").bitwiseXOR(F.col(f"r.p{k}"))) for k in range(SKETCH)), F.lit(0))
    reach = (most >= threshold * (both - most) - 1e-9) & (apart <= both * ((1 - threshold) / (1 + threshold)) + 1e-9)
    more = materialize(open_pairs(still, reach).join(stars, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return first
    more = verified(sets, more, threshold)
    return first if more.isEmpty() else components(links.unionByName(more))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size, and whether it is the one to keep."""
    rows = with_node(docs, "doc_id").drop("_text")
    known = rows.join(labels(docs, threshold), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sums = known.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return known.join(sums, "label").select("doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of one document of each class: that with the least doc_id, ties by text."""
    rows = with_node(docs, "doc_id").drop("_text")
    known = rows.join(labels(docs, threshold), "node", "left")
    pick = F.min(F.struct("doc_id", "node"))
    grouped = known.where("label is not null").groupBy("label").agg(pick.alias("k"))
    alone = known.where("label is null").groupBy("node").agg(pick.alias("k"))
    keep = grouped.select("k.*").unionByName(alone.select("k.*"))
    own = boxed(docs).withColumn("node", F.struct("_th", F.xxhash64(F.lit(1), "text")))
    kept = own.join(keep, own["doc_id"].eqNullSafe(keep["doc_id"]) & (own["node"] == keep["node"])).select("row", own["doc_id"], own["node"])
    return unboxed(kept.dropDuplicates(["doc_id", "node"]), docs, F.col("row.text"))
