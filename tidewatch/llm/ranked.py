"""Ranked lexical search by norm buckets, in the manner of LEMP.

Every document is a vector of term impacts and every item a vector of term counts, so that a score is an inner product.
Documents are cut to the terms that any item of the block has, which changes no product. They are range-partitioned by
falling length of their vectors, and each task cuts its rows into buckets of similar length. For an item and a bucket

* Cauchy and Schwarz prune: no document reaches the item's threshold if |item| * |longest document| does not;
* in a bucket that stays, the threshold divided by both lengths is a cosine; each coordinate of a document's unit vector
  must then lie in an interval around that of the item. Coordinates whose interval excludes zero are looked up in the
  bucket's postings, and only documents in all of them survive;
* survivors are scored exactly in 64-bit integers.

The longest documents are searched first; the k-th best score that they give an item is where all tasks start from, and
each task raises it by what it finds. Bounds are compared with a slack far above rounding, and ties are never pruned.

Items are worked in blocks of bounded size (BLOCK_TERMS), of which a task holds one; documents stay partitioned.

Defined results: null text has no term; an item without terms, or none of whose terms any document has, gives no rows.
Repeated items are ranked each on its own, repeated documents are ranked each as a row of its own, in any order among
themselves; null doc_ids rank after others of the same score. No documents or no items give no rows. Other columns of
both tables are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

#: Distinct terms of items, added up, that one block of items has on average.
BLOCK_TERMS = 400_000
#: Rows and entries at which a bucket is closed, the least rows that a fall in length may close, and that fall.
BUCKET_ROWS, BUCKET_ENTRIES, LEAST_ROWS, FALL = 8192, 1 << 20, 64, 0.9
#: Share of the documents, the longest ones, that are searched first.
FIRST = 0.01
#: Relative slack of bounds in doubles.
SLACK = 1e-9

#: A-Z to a-z; 0-9, a-z and all bytes from 0x80 on stay, others separate terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def _counted(text: str | None) -> Counter:
    found = Counter(terms(text))
    found.pop(b"", None)
    return found


def item_vectors(items: DataFrame, key: str, text: str) -> DataFrame:
    """iid (unique), the item's key, its distinct terms and their counts; written. Items without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_counted(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("iid"), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["iid", "terms", "counts"])

    rows = materialize(items.select(F.monotonically_increasing_id().alias("iid"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    vectors = rows.select("iid", "text").mapInArrow(run, "iid long, terms array<binary>, counts array<long>").where("size(terms) > 0")
    return materialize(vectors.join(rows.select("iid", "key"), "iid"))


def document_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and numbers and counts of those terms that the vocabulary has; documents without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            for part in slices(batch):
                ns, ids, counts = [], [], []
                for t in part.column("text").to_pylist():
                    all_terms = terms(t)
                    ns.append(len(all_terms) - all_terms.count(b""))
                    found = Counter(map(get, all_terms))
                    found.pop(None, None)
                    ids.append(list(found))
                    counts.append(list(found.values()))
                yield pa.record_batch([part.column("doc_id"), pa.array(ns, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "ids", "counts"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, ids array<int>, counts array<long>").where("n > 0")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def impacts(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, norm and the impacts of each document that has a term of weight; terms without weight go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            m = 25 + (75 * batch.column("n").to_numpy() * n_docs) // n_terms
            ids, tf = _flat(batch, "ids"), _flat(batch, "counts")
            value = weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            keep = value > 0
            row, ids, value = row[keep], ids[keep], value[keep]
            norm = np.sqrt(np.bincount(row, value.astype(float) ** 2, len(sizes)))
            at = pa.array(_starts(np.bincount(row, minlength=len(sizes))), pa.int32())
            yield pa.record_batch([batch.column("doc_id"), pa.array(norm), pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(value))], names=["doc_id", "norm", "ids", "impacts"])

    return vectors.mapInArrow(run, "doc_id long, norm double, ids array<int>, impacts array<long>").where("norm > 0")


class Queries:
    """A block of items as vectors over the block's vocabulary; bounded by BLOCK_TERMS, so every task may hold it."""

    def __init__(self, rows: list, vocabulary: dict[bytes, int]):
        self.keys = [r["iid"] for r in rows]
        self.ids = [np.array([vocabulary[bytes(t)] for t in r["terms"]], np.int64) for r in rows]
        self.counts = [np.array(r["counts"], np.int64) for r in rows]
        self.norms = [math.sqrt(float((c.astype(float) ** 2).sum())) for c in self.counts]


class _Bucket:
    """Documents of similar length, the longest first, with their postings."""

    def __init__(self, docs: np.ndarray, norms: np.ndarray, starts: np.ndarray, ids: np.ndarray, values: np.ndarray, n_terms: int):
        self.docs, self.norms, self.starts, self.ids, self.values = docs, norms, starts, ids, values
        row = np.repeat(np.arange(len(norms)), np.diff(starts))
        order = np.argsort(ids, kind="stable")
        self.edges = np.searchsorted(ids[order], np.arange(n_terms + 1))
        self.rows, self.impact = row[order], values[order]
        self.unit = self.impact / norms[self.rows]

    def survivors(self, ids: np.ndarray, unit: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose coordinates allow a cosine of at least `cosine`, ascending; None if no coordinate excludes zero."""
        spread, found = math.sqrt(max(0.0, 1 - cosine * cosine)), None
        for f in np.argsort(-unit):
            q = float(unit[f])
            reach = spread * math.sqrt(max(0.0, 1 - q * q))
            least, most = q * cosine - reach - SLACK, 1.0 if q >= cosine else q * cosine + reach
            if least <= 0:  # so it is for all smaller coordinates
                break
            a, b = self.edges[ids[f]], self.edges[ids[f] + 1]
            rows = self.rows[a:b][(self.unit[a:b] >= least) & (self.unit[a:b] <= most + SLACK)]
            found = rows if found is None else np.intersect1d(found, rows, assume_unique=True)
            if not len(found):
                break
        return found

    def scores(self, ids: np.ndarray, counts: np.ndarray, rows: np.ndarray | None, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of `rows` (None: of all), as (rows, scores)."""
        if rows is None:
            out = np.zeros(len(self.norms), np.int64)
            for f, c in zip(ids.tolist(), counts.tolist()):
                a, b = self.edges[f], self.edges[f + 1]
                out[self.rows[a:b]] += c * self.impact[a:b]
            return np.arange(len(out)), out
        if not len(rows):
            return rows, np.zeros(0, np.int64)
        first, sizes = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        at = _starts(sizes)
        entry = np.arange(at[-1]) + np.repeat(first - at[:-1], sizes)
        dense[ids] = counts
        out = np.add.reduceat(dense[self.ids[entry]] * self.values[entry], at[:-1])
        dense[ids] = 0
        return rows, out


class _Search:
    """What one task knows: the best k rows of each item so far, and the score that a further row must reach."""

    def __init__(self, queries: Queries, floor: dict[int, int], k: int, n_terms: int):
        self.queries, self.k, self.n_terms = queries, k, n_terms
        self.floor = [max(1, floor.get(key, 1)) for key in queries.keys]
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.keys]
        self.dense = np.zeros(n_terms, np.int64)

    def meet(self, bucket: _Bucket) -> None:
        q = self.queries
        for i, (ids, counts, norm) in enumerate(zip(q.ids, q.counts, q.norms)):
            floor = self.floor[i]
            if norm * bucket.norms[0] * (1 + SLACK) < floor:
                continue
            rows = bucket.survivors(ids, counts / norm, min(1.0, floor / (norm * bucket.norms[0]) * (1 - SLACK)))
            rows, scores = bucket.scores(ids, counts, rows, self.dense)
            good = scores >= floor
            if good.any():
                self.keep(i, scores[good], bucket.docs[rows[good]])

    def keep(self, i: int, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.best[i][0], scores]), np.concatenate([self.best[i][1], docs])
        if len(scores) > self.k:
            top = np.lexsort((docs, -scores))[: self.k]
            scores, docs = scores[top], docs[top]
        self.best[i] = scores, docs
        if len(scores) == self.k:
            self.floor[i] = max(self.floor[i], int(scores.min()))


#: Stands for a null doc_id, which ranks last.
_NULL = np.iinfo(np.int64).max


def _best_rows(vectors: DataFrame, queries: Queries, floor: dict[int, int], k: int, n_terms: int) -> DataFrame:
    """iid, doc_id, score: what each task of rows, sorted by falling norm, finds best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(queries, floor, k, n_terms)
        docs, norms, sizes, ids, values = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

        def close(last: bool) -> None:
            nonlocal docs, norms, sizes, ids, values
            starts, a = _starts(sizes), 0
            while a < len(docs):
                b = a + int(np.searchsorted(-norms[a:], -FALL * norms[a], side="right"))
                b = min(max(b, a + LEAST_ROWS), a + BUCKET_ROWS, max(a + 1, int(np.searchsorted(starts, starts[a] + BUCKET_ENTRIES, side="right")) - 1))
                if b >= len(docs) and not last:
                    break
                b = min(b, len(docs))
                search.meet(_Bucket(docs[a:b], norms[a:b], starts[a : b + 1] - starts[a], ids[starts[a] : starts[b]], values[starts[a] : starts[b]], n_terms))
                a = b
            docs, norms, sizes, ids, values = docs[a:], norms[a:], sizes[a:], ids[starts[a] :], values[starts[a] :]

        for batch in batches:
            docs = np.concatenate([docs, batch.column("doc_id").fill_null(_NULL).to_numpy()])
            norms = np.concatenate([norms, batch.column("norm").to_numpy()])
            sizes = np.concatenate([sizes, pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)])
            ids, values = np.concatenate([ids, _flat(batch, "ids")]), np.concatenate([values, _flat(batch, "impacts")])
            close(False)
        close(True)
        for key, (scores, found) in zip(queries.keys, search.best):
            if len(scores):
                yield pa.record_batch([pa.array(np.full(len(scores), key)), pa.array(found, pa.int64()), pa.array(scores)], names=["iid", "doc_id", "score"])

    return vectors.mapInArrow(run, "iid long, doc_id long, score long")


def _by_norm(vectors: DataFrame) -> DataFrame:
    """Rows dealt and sorted by falling norm; equal norms are told apart by a hash, so that copies do not meet in one task."""
    spread = vectors.withColumn("_h", F.xxhash64("doc_id"))
    return spread.repartitionByRange(F.desc("norm"), "_h").sortWithinPartitions(F.desc("norm")).drop("_h")


def _search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    rows = block.collect()  # bounded by BLOCK_TERMS
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
    queries, n_terms = Queries(rows, vocabulary), len(vocabulary)
    vectors = materialize(document_vectors(docs, vocabulary))
    n_docs, all_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(n_terms, np.int64)
    for r in vectors.select(F.explode("ids").alias("i")).groupBy("i").count().collect():  # at most the block's vocabulary
        df[r["i"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    found = materialize(impacts(vectors, weights, n_docs, all_terms or 1))
    longest = found.agg(F.percentile_approx("norm", 1 - FIRST, 10_000)).first()[0]
    if longest is None:
        longest = 0.0
    by_score = Window.partitionBy("iid").orderBy(F.desc("score"), "doc_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    first = materialize(best(_best_rows(_by_norm(found.where(F.col("norm") >= longest)), queries, {}, k, n_terms)))
    floor = {r["iid"]: r["score"] for r in first.where(F.col("rank") == k).collect()}  # one row an item of the block
    rest = _best_rows(_by_norm(found.where(F.col("norm") < longest)), queries, floor, k, n_terms)
    return materialize(best(first.drop("rank").unionByName(rest)))


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """`key`, rank (from 1), doc_id, score of each item's k best documents with a score above 0; equal scores by doc_id."""
    queries = item_vectors(items, key, text)
    size = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = math.ceil(size / BLOCK_TERMS)
    ranked = None
    for b in range(blocks):
        part = _search_block(docs, queries.where(F.pmod(F.xxhash64("iid"), F.lit(blocks)) == b).select("iid", "terms", "counts"), k)
        ranked = part if ranked is None else ranked.unionByName(part)
    if ranked is None:
        ranked = queries.sparkSession.createDataFrame([], "iid long, doc_id long, score long, rank int")
    doc = F.when(F.col("doc_id") != int(_NULL), F.col("doc_id"))
    return ranked.join(queries.select("iid", F.col("key").alias(key)), "iid").select(key, F.col("rank").cast("int").alias("rank"), doc.alias("doc_id"), "score")
