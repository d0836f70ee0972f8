"""Repeated substrings by a sparse suffix array with deep-shallow sorting.

Every `window`-byte string has one anchor: the leftmost position whose
`gram`-byte hash is least among its positions. Equal strings have equal anchors at
equal places, so it suffices to sort the suffixes that start at anchors and to
extend matches to the left. Spark counts anchor hashes over the whole corpus;
anchors that occur once are done. Runs of windows around an anchor that are equal
as a whole collapse to one row with a count. What is left is sorted in buckets of whole
anchor hashes: a multikey quicksort orders a bucket's suffixes to a shallow depth, which
parts its anchors from each other, and blind tries
(Patricia tries that compare branch bytes first and verify once) order the groups
with long common prefixes. At each trie node the suffixes are kept in order of
their left sides, and neighbours give the longest two-sided match.

Groups with more than GROUP suffixes are split by the windows themselves, which
Spark counts by digest with partial aggregation.

Defined results: null text counts as empty; texts shorter than `window` lose
nothing; copies of a row (same doc_id and text) are separate documents; an empty
table gives an empty result; `remove` carries all other columns, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, boxed, keyed, materialize, mix, same_doc, slices, text_bytes, unboxed
from .graph import small

WORD = 8
GROUP = 20_000
#: Suffixes from which a bucket takes no further anchor hash.
BUCKET = 256
#: Windows of a long text that one step handles.
SEGMENT = 1 << 22
#: `place` holds distances in a run in 12 bits.
MOST_WINDOW = 4095
_POS = np.uint64((1 << 28) - 1)
_HIGH = np.uint64(~((1 << 28) - 1) & 0xFFFFFFFFFFFFFFFF)


def gram_of(window: int) -> int:
    if window > MOST_WINDOW:
        raise ValueError(f"a window has at most {MOST_WINDOW} bytes")
    return max(4, window * 6 // 25)


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: document, anchor, first and last window, anchor hash, digest of the run."""
    gram = gram_of(window)
    w = window - gram + 1
    for base in range(0, max(len(data) - window + 1, 0), SEGMENT):
        part = data[base : base + SEGMENT + window - 1]
        roll, many = Rolling(part), len(part) - gram + 1
        at = np.arange(many)
        h = roll.spans(at, at + gram)
        key = np.full(-(-many // w) * w, np.iinfo(np.uint64).max, np.uint64)
        key[:many] = (h & _HIGH) | at.astype(np.uint64)
        block = key.reshape(-1, w)
        before = np.minimum.accumulate(block, axis=1).ravel()
        after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - window + 1
        anchor = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & _POS).astype(np.int64)
        valid = np.zeros(n + 1, np.int32)
        lo, hi = np.clip(starts - base, 0, n), np.clip(ends - window + 1 - base, 0, n)
        some = hi > lo
        np.add.at(valid, lo[some], 1)
        np.add.at(valid, hi[some], -1)
        valid = np.cumsum(valid[:n]) > 0
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first_of_doc = (starts - base)[(starts >= base) & (starts < base + n)]
        new[first_of_doc] = valid[first_of_doc]
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = valid.copy()
        stop[:-1] &= new[1:] | ~valid[1:]
        last = np.flatnonzero(stop)
        m = anchor[first]
        run = mix(roll.spans(first, last + window) + (m - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        doc = np.searchsorted(starts, first + base, "right") - 1
        yield doc, m + base - starts[doc], first + base - starts[doc], last + base - starts[doc], h[m], run


def anchors(keyed_docs: DataFrame, window: int, full: bool) -> DataFrame:
    """One row per run: hashes kh, ch and, if `full`, the document and `place` (first window, anchor and last window packed)."""
    schema = "kh long, ch long" + ", doc_id long, _th long, place long" * full

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, starts, ends = text_bytes(part.column("text"))
                for doc, m, lo, hi, kh, ch in _runs(data, starts, ends, window):
                    cols = [pa.array(kh.view(np.int64)), pa.array(ch.view(np.int64))]
                    names = ["kh", "ch"]
                    if full:
                        rows = pa.array(doc)
                        cols += [part.column("doc_id").take(rows), part.column("_th").take(rows), pa.array(lo << 24 | (m - lo) << 12 | (hi - lo))]
                        names += ["doc_id", "_th", "place"]
                    yield pa.record_batch(cols, names=names)

    return keyed_docs.mapInArrow(run, schema)


def unplace(place: int) -> tuple[int, int, int]:
    """First window, anchor, last window."""
    lo = place >> 24
    return lo, lo + (place >> 12 & 4095), lo + (place & 4095)


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return n - (x.bit_length() + 7) // 8


def multikey_quicksort(items: list[bytes], shallow: int) -> list[list[int]]:
    """Indexes in order of the items, in groups that are equal in the first `shallow` bytes.

    Ternary partitions on WORD bytes at a time: less, equal (one word deeper), greater.
    """
    out, stack = [], [(list(range(len(items))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2 or depth >= shallow:
            if group:
                out.append(group)
            continue
        words = [items[i][depth : min(depth + WORD, shallow)] for i in group]
        pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
        less = [i for i, x in zip(group, words) if x < pivot]
        same = [i for i, x in zip(group, words) if x == pivot]
        more = [i for i, x in zip(group, words) if x > pivot]
        stack.append((more, depth))
        stack.append((same, depth + WORD))
        stack.append((less, depth))
    return out


class BlindTrie:
    """Patricia trie of byte strings that keeps only branching depths and branch bytes."""

    def __init__(self, items: list[bytes]):
        self.items, self.root = items, None

    def _branch(self, x: bytes, depth: int) -> int:
        return x[depth] if depth < len(x) else -1

    def add(self, index: int) -> None:
        x = self.items[index]
        if self.root is None:
            self.root = [index]
            return
        path, node = [], self.root
        while isinstance(node, tuple):  # blind: look at branch bytes only
            byte = self._branch(x, node[0])
            byte = byte if byte in node[1] else next(iter(node[1]))
            path.append((node, byte))
            node = node[1][byte]
        y = self.items[node[0]]
        depth = shared_prefix(x, y)  # the one verification
        if depth == len(x) == len(y):
            node.append(index)
            return
        k = next((k for k, (p, _) in enumerate(path) if p[0] >= depth), len(path))
        below = path[k][0] if k < len(path) else node
        if k < len(path) and below[0] == depth:
            below[1][self._branch(x, depth)] = [index]
            return
        fork = (depth, {self._branch(y, depth): below, self._branch(x, depth): [index]})
        if k:
            path[k - 1][0][1][path[k - 1][1]] = fork
        else:
            self.root = fork

    def walk(self):
        """Nodes in post-order, children by branch byte: (depth, the children's keys or None, the leaf's indexes)."""
        stack = [(self.root, False)]
        while stack:
            node, seen = stack.pop()
            if isinstance(node, list):
                yield len(self.items[node[0]]), 0, node
            elif seen:
                yield node[0], len(node[1]), None
            else:
                stack.append((node, True))
                stack += [(node[1][b], False) for b in sorted(node[1], reverse=True)]


def matches(rights: list[bytes], lefts: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    """For each suffix the distances d from a window's start to the anchor, as ranges, at which another suffix has the same window.

    `rights` start at the anchor; `lefts` are the bytes before it, nearest first.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in rights]

    def meet(i: int, j: int, depth: int) -> None:
        left = shared_prefix(lefts[i], lefts[j])
        if left + depth >= window:
            span = (max(window - depth, 0), left)
            found[i].append(span)
            found[j].append(span)

    for group in multikey_quicksort(rights, gram_of(window)):  # two-sided matches share no less than that to the right
        if len(group) == 2:
            meet(*group, shared_prefix(rights[group[0]], rights[group[1]]))
        elif len(group) > 2:
            trie = BlindTrie(rights)
            for i in group:
                trie.add(i)
            held: list[list[tuple[bytes, int]]] = []
            for depth, children, leaf in trie.walk():
                parts = [[(lefts[i], i)] for i in leaf] if leaf else [held.pop() for _ in range(children)]
                parts.sort(key=len)
                order = parts.pop()
                for part in parts:
                    for entry in part:
                        at = bisect.bisect(order, entry)
                        for k in (at - 1, at):
                            if 0 <= k < len(order):
                                meet(entry[1], order[k][1], depth)
                        order.insert(at, entry)
                held.append(order)
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


CONTEXT = "kh long, ch long, n long, before int, windows int, bytes binary"
_CONTEXT = pa.schema([("kh", pa.int64()), ("ch", pa.int64()), ("n", pa.int64()), ("before", pa.int32()), ("windows", pa.int32()), ("bytes", pa.binary())])
FOUND = "kh long, ch long, spans array<struct<lo:int,hi:int>>"
_FOUND = pa.schema([("kh", pa.int64()), ("ch", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))])


def _contexts(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Bytes of the runs in `wanted` (doc_id, _th, runs): one row per run, `before` bytes up to the anchor, `windows` windows."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text = (batch.column("text")[k].as_py() or "").encode("utf-8", "surrogatepass")
                rows = []
                for r in batch.column("runs")[k].as_py():
                    lo, m, hi = unplace(r["place"])
                    rows.append({"kh": r["kh"], "ch": r["ch"], "n": r["n"], "before": m - lo, "windows": hi - lo + 1, "bytes": text[lo : hi + window]})
                yield pa.RecordBatch.from_pylist(rows, schema=_CONTEXT)

    return texts.join(wanted, same_doc(texts, wanted)).select(texts["text"], wanted["runs"]).mapInArrow(run, CONTEXT)


def buckets(rows: Iterable[tuple], size: int = BUCKET) -> Iterator[list[tuple]]:
    """Rows (kh, ch, ...) in order of both, cut into buckets: whole anchor hashes until there are `size` rows. Copies of a run come once."""
    bucket: list[tuple] = []
    for row in rows:
        if bucket and bucket[-1][0] != row[0] and len(bucket) >= size:
            yield bucket
            bucket = []
        if not bucket or bucket[-1][:2] != row[:2]:
            bucket.append(row)
    if bucket:
        yield bucket


def _sort_groups(contexts: DataFrame, window: int) -> DataFrame:
    """Ranges of windows (counted from the run's first) that occur elsewhere, by deep-shallow sorting of buckets of anchor hashes."""

    def solve(group: list[tuple]) -> list[dict]:
        rights = [b[before : before + window] for _, _, _, before, _, b in group]
        lefts = [b[:before][::-1] for _, _, _, before, _, b in group]
        out = []
        for (kh, ch, n, before, windows, _), spans in zip(group, matches(rights, lefts, window)):
            if n > 1:
                spans = [(0, windows - 1)]
            else:
                spans = merged([(max(before - d1, 0), min(before - d0, windows - 1)) for d0, d1 in spans if d1 >= before - windows + 1 and d0 <= before])
            if spans:
                out.append({"kh": kh, "ch": ch, "spans": [{"lo": a, "hi": b} for a, b in spans if a <= b]})
        return out

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for bucket in buckets(rows):
            yield pa.RecordBatch.from_pylist(solve(bucket), schema=_FOUND)

    return contexts.repartition("kh").sortWithinPartitions("kh", "ch").mapInArrow(run, FOUND)


def _count_windows(contexts: DataFrame, window: int) -> DataFrame:
    """The same for groups too large for one task: every window of the runs becomes a digest that Spark counts."""
    schema = pa.schema([("kh", pa.int64()), ("ch", pa.int64()), ("at", pa.int32()), ("n", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])

    def run(batches):
        for batch in batches:
            for kh, ch, n, _, windows, b in zip(*(c.to_pylist() for c in batch.columns)):
                ids = [struct.unpack("<qq", hashlib.blake2b(b[i : i + window], digest_size=16).digest()) for i in range(windows)]
                w1, w2 = zip(*ids)
                yield pa.record_batch([pa.array([kh] * windows), pa.array([ch] * windows), pa.array(range(windows), pa.int32()), pa.array([n] * windows), pa.array(w1), pa.array(w2)], schema=schema)

    each = contexts.dropDuplicates(["kh", "ch"]).mapInArrow(run, "kh long, ch long, at int, n long, w1 long, w2 long")
    again = each.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
    return each.join(again, ["w1", "w2"]).groupBy("kh", "ch").agg(F.transform(F.collect_set("at"), lambda a: F.struct(a.alias("lo"), a.alias("hi"))).alias("spans"))


def repeated(texts: DataFrame, window: int = 200, group: int = GROUP) -> DataFrame:
    """doc_id, _th and `cuts`: byte ranges [a, b) of keyed documents that windows occurring elsewhere cover.

    Hot anchors are counted by partial aggregation; the table of repeated ones is written, so that adaptive execution can
    split their share of the join. Runs of one anchor hash (62 bits) are taken as equal if their own hashes are.
    """
    counted = anchors(texts, window, False).groupBy("kh").agg(F.count("*").alias("n"), F.min("ch").alias("c0"), F.max("ch").alias("c1"))
    twice = materialize(counted.where("n > 1").select("kh", (F.col("c0") == F.col("c1")).alias("same")))
    runs = materialize(anchors(texts, window, True).join(twice, "kh"))
    other = runs.where("not same")
    first = F.struct("doc_id", "_th", "place")
    distinct = materialize(other.groupBy("kh", "ch").agg(F.count("*").alias("n"), F.min(first).alias("f")).select("kh", "ch", "n", "f.*"))
    wanted = distinct.groupBy("doc_id", "_th").agg(F.collect_list(F.struct("kh", "ch", "n", "place")).alias("runs"))
    contexts = materialize(_contexts(texts, wanted, window))
    large = small(materialize(distinct.groupBy("kh").agg(F.count("*").alias("many")).where(F.col("many") > group).select("kh")))
    found = _sort_groups(contexts.join(large, "kh", "left_anti"), window)
    if not large.isEmpty():
        found = found.unionByName(_count_windows(contexts.join(large, "kh", "left_semi"), window))
    found = materialize(found)
    lo = F.shiftright("place", 24)
    hi = lo + F.col("place").bitwiseAND(4095)
    whole = runs.where("same").select("doc_id", "_th", F.struct(lo.alias("a"), (hi + window).alias("b")).alias("cut"))
    part = other.join(found, ["kh", "ch"]).select("doc_id", "_th", "place", F.explode("spans").alias("s")).select("doc_id", "_th", F.struct((lo + F.col("s.lo")).alias("a"), (lo + F.col("s.hi") + window).alias("b")).alias("cut"))
    return whole.unionByName(part).groupBy("doc_id", "_th").agg(F.collect_list("cut").alias("cuts"))


def _spans(cuts: list[dict] | None) -> list[tuple[int, int]]:
    return [(a, b + 1) for a, b in merged([(c["a"], c["b"] - 1) for c in cuts or ()])]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def digest(docs: DataFrame, window: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = keyed(docs)
    cuts = repeated(texts, window)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text, found in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("cuts").to_pylist()):
                    raw, spans = text.encode("utf-8", "surrogatepass"), _spans(found)
                    rows.append((doc, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()))
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.join(cuts, same_doc(texts, cuts), "left").select(texts["doc_id"], texts["text"], cuts["cuts"]).mapInArrow(run, schema)


def on_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Shrink byte ranges to whole UTF-8 characters."""
    tail = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while tail(a):
            a += 1
        while tail(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove(docs: DataFrame, window: int = 200) -> DataFrame:
    """All columns of `docs`, with repeated substrings cut out of `text` at whole characters; null texts stay null."""
    own, cuts = boxed(docs), repeated(keyed(docs), window)
    both = own.join(cuts, own["doc_id"].eqNullSafe(cuts["doc_id"]) & (own["_th"] == cuts["_th"]), "left").select("row", "text", "cuts")
    schema = both.drop("cuts").schema

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = []
                for text, found in zip(part.column("text").to_pylist(), part.column("cuts").to_pylist()):
                    if found:
                        raw = text.encode("utf-8", "surrogatepass")
                        text = _kept(raw, on_characters(raw, _spans(found))).decode("utf-8", "surrogatepass")
                    texts.append(text)
                yield pa.record_batch([part.column("row"), pa.array(texts, part.column("text").type)], names=["row", "text"])

    return unboxed(both.mapInArrow(run, schema), docs, F.when(F.col("row.text").isNotNull(), F.col("text")))
