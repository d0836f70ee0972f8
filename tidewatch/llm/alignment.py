"""Cross-tokenizer alignment through inverted bitmaps of id pairs.

Both tokenizers split a text, with a space before it, into tokens of bytes. Byte offsets where a token of each ends cut
the tokens into groups; the two tokens that end at such an offset are linked. How often a pair of ids is linked corpus-wide
comes from an inverted table: per pair and block of documents a compressed bitmap of the documents that have it, as planes
of the number of links per document. The parts of a block that different tasks have seen are merged by OR; population
counts give documents and links. The counts then go back along the postings to the documents.

Texts are cut before each space that follows a character other than white space. Neither tokenizer crosses such a cut, so
a stretch between cuts is encoded and aligned once per worker table (bounded in entries, not in results); a model with
pieces across spaces makes the whole text one stretch.

Defined results: texts that are null, empty, or whose bytes the tokens of one side do not give back have no tokens: zeros,
and '' as groups_sha256. Repeated rows count each. No documents give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .common import materialize, slices
from .graph import small
from .tokens import _MARKS, ChunkTable, MarkedWordEncoder, SpaceLedEncoder, encoder

#: Entries (document and pair) after which a block of documents is closed, and of stretches a worker's table holds in each generation.
BLOCK_ENTRIES, TABLE = 1_500_000, 200_000
_LOW = 0xFFFFFFFF


def _sums(sizes: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    """The bytes of each list of tokens."""
    run = np.concatenate(([0], np.cumsum(sizes[np.fromiter(chain.from_iterable(lists), np.int64)])))
    at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
    return run[at[1:]] - run[at[:-1]]


class Aligner:
    """Aligns stretches and whole texts of two tokenizers, A (byte-level) and B (marked pieces)."""

    #: Before each space that follows a character other than white space.
    _cut = re.compile(r"(?<=\S) ")
    _white = re.compile(r"\s ")

    def __init__(self, paths: tuple[str, str]):
        self.a, self.b = SpaceLedEncoder(paths[0]), MarkedWordEncoder(paths[1])
        for table in (self.a.table, self.a.heads, self.a.pre, self.b.table):
            table.limit = 20_000
        letters = {c: b for b, c in self.a._letters.items()}
        vocabulary = self.a.tok.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        model = self.b.model
        byte = re.compile("<0x([0-9A-F]{2})>")
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.names = np.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))], dtype=object)
        self.table = ChunkTable(self.stretch, TABLE)

    def align(self, a: list[int], b: list[int]) -> tuple[str, list[int]]:
        """The groups as text, and the linked pairs as a * 2**32 + b, of tokens that cover the same bytes."""
        groups, links, i, j, at_a, at_b, first_a, first_b = [], [], 0, 0, 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                at_a += len(self.a_bytes[a[i]])
                i += 1
            else:
                at_b += len(self.b_bytes[b[j]])
                j += 1
            if at_a == at_b:
                groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
                links.append(a[i - 1] << 32 | b[j - 1])
                first_a, first_b = i, j
        return ";".join(groups), links

    def whole(self, a: list[int], b: list[int], raw: bytes) -> tuple[int, int, str, bytes, bool]:
        """Numbers of tokens, groups, links and whether both sides give the bytes back."""
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return 0, 0, "", b"", False
        groups, links = self.align(a, b)
        return len(a), len(b), groups, np.array(links, np.int64).tobytes(), True

    def stretch(self, rest: str) -> tuple[int, int, str, bytes, bool]:
        """A stretch without the space that leads it."""
        text = " " + rest
        return self.whole(np.frombuffer(self.a(text), "<u4").tolist(), np.frombuffer(self.b(rest), "<u4").tolist() if rest else self.lone(), text.encode())

    def lone(self) -> list[int]:
        return [self.b.model.piece_to_id("▁")]

    def a_ids(self, rest: str) -> list[int]:
        """A's ids of a stretch; plain words go straight to its model."""
        ascii_ = rest.isascii()
        if ascii_ or self.a._common.fullmatch(rest):
            if rest.isalpha():
                text = self.a._letters[32] + rest if ascii_ else (" " + rest).encode().decode("latin-1").translate(self.a._letters)
                return [t.id for t in self.a.model.tokenize(text)]
            if rest[-1:] in _MARKS and rest[:-1].isalpha():
                return [*self.a_ids(rest[:-1]), *np.frombuffer(self.a.pre[rest[-1]], "<u4").tolist()]
        return np.frombuffer(self.a(" " + rest), "<u4").tolist()

    def fill(self, rests: list[str]) -> None:
        """Put stretches into the table, all aligned at once; those whose bytes do not come back go one by one."""
        a = [self.a_ids(r) for r in rests]
        b = self.b.model.encode(rests, num_threads=1) if rests else []
        b = [x if r else self.lone() for r, x in zip(rests, b)]
        size = [len(r.encode()) + 1 for r in rests]
        good = ((_sums(self.a_size, a) == size) & (_sums(self.b_size, b) == size)).tolist()
        for r in (r for r, g in zip(rests, good) if not g):
            self.table[r]
        rests, a, b, size = ([x for x, g in zip(side, good) if g] for side in (rests, a, b, size))
        if not rests:
            return
        fa, fb = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        raw = b"".join([b" " + r.encode() for r in rests])
        if any(b"".join([known[i] for i in f.tolist()]) != raw for known, f in ((self.a_bytes, fa), (self.b_bytes, fb))):
            for r in rests:
                self.table[r]
            return
        # Both sides cover the same bytes of every stretch, so offsets over all of them can be compared.
        ends_a, ends_b, ends = np.cumsum(self.a_size[fa]), np.cumsum(self.b_size[fb]), np.cumsum(size)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = fa[np.searchsorted(ends_a, common)] << 32 | fb[np.searchsorted(ends_b, common)]
        of = np.searchsorted(ends, common)
        key = np.concatenate([2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1])
        order = np.argsort(key, kind="stable")
        key, group = key[order], key[order] // 2
        text = np.empty(2 * len(key) - 1, dtype=object)
        text[::2] = self.names[np.concatenate([fa, fb])[order]]
        text[1::2] = np.where(key[1:] == key[:-1], ",", np.where(group[1:] == group[:-1], "|", np.where(of[group[1:]] == of[group[:-1]], ";", "\n"))).astype(object)
        groups, cuts, raw = "".join(text.tolist()).split("\n"), (8 * np.searchsorted(of, np.arange(len(rests) + 1))).tolist(), links.tobytes()
        for r, x, y, g, i, j in zip(rests, a, b, groups, cuts, cuts[1:]):
            self.table.put(r, (len(x), len(y), g, raw[i:j], True))

    def parts(self, text: str) -> list[str]:
        """The stretches of a text, each without the space that leads it."""
        if "  " in text or text[:1] == " " or self._white.search(text):
            parts = self._cut.split(" " + text)
            parts[0] = parts[0][1:]
            return parts
        return text.split(" ")

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, bytes]]:
        """n_a, n_b, groups and links of each text; zeros and nothing if one side does not give its bytes back."""
        if self.b.whole or not self.a.plain:
            yield from (self.stretch(t)[:4] if t else (0, 0, "", b"") for t in texts)
            return
        parts = [self.parts(t) if t else [] for t in texts]
        self.fill([p for p in {p for each in parts for p in each} if p not in self.table and p not in self.table.old])
        for t, each in zip(texts, parts):
            yield self.joined(t, each) if t else (0, 0, "", b"")

    def joined(self, text: str, parts: list[str]) -> tuple[int, int, str, bytes]:
        n_a, n_b, groups, links, ok = zip(*map(self.table.__getitem__, parts))
        if not all(ok):
            # Stretches that differ could still add up to the text, so the whole of it decides.
            return self.whole(np.frombuffer(self.a(" " + text), "<u4").tolist(), self.b.model.encode(text), (" " + text).encode())[:4]
        return sum(n_a), sum(n_b), ";".join(groups), b"".join(links)


_ENCODED = "doc_id long, block long, at int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per document its place (block, at), its numbers and digest, and its distinct pairs with their numbers of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = encoder(Aligner, (a, b))
        task, block, at, entries = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            for part in slices(batch):
                rows, pairs, times, sizes = [], [], [], [0]
                for n_a, n_b, groups, links in align.texts(part.column("text").to_pylist()):
                    codes, n = np.unique(np.frombuffer(links, np.int64), return_counts=True)
                    if at and (at == bitmaps.BLOCK or entries + len(codes) > BLOCK_ENTRIES):
                        block, at, entries = block + 1, 0, 0
                    rows.append((task << 32 | block, at, n_a, n_b, len(links) // 8, len(links) // 8, hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
                    at, entries = at + 1, entries + len(codes)
                    pairs.append(codes)
                    times.append(n)
                    sizes.append(sizes[-1] + len(codes))
                if not rows:
                    continue
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                offsets = pa.array(sizes, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
                yield pa.record_batch([part.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds)), *lists], names=["doc_id", "block", "at", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ENCODED)


def postings(encoded: DataFrame) -> DataFrame:
    """pair, block, planes: what a task's rows add to the inverted table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries, of = [], 0, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, entries
            if held:
                pair, at, n = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((at, pair))
                keys, planes = bitmaps.counted(pair[order], at[order], n[order])
                for i in range(0, len(keys), 20_000):
                    yield pa.record_batch([pa.array(keys[i : i + 20_000]), pa.array(np.full(len(keys[i : i + 20_000]), of)), planes.slice(i, 20_000)], names=["pair", "block", "planes"])
            held, entries = [], 0

        for batch in batches:
            blocks, ats = batch.column("block").to_numpy(), batch.column("at").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if blocks[i] != of or entries > BLOCK_ENTRIES:
                    yield from close()
                    of = int(blocks[i])
                part = batch.slice(i, j - i)
                pairs, times = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
                sizes = part.column("pairs").value_lengths().to_numpy(zero_copy_only=False)
                held.append((pairs, np.repeat(ats[i:j], sizes), times))
                entries += len(pairs)
        yield from close()

    return encoded.where("n_links > 0").select("block", "at", "pairs", "times").mapInArrow(run, "pair long, block long, planes array<binary>")


def inverted(parts: DataFrame) -> DataFrame:
    """pair, block, planes, docs, links: the parts of a block merged by OR, with their population counts.

    A block has as many parts as tasks have read rows of it, and each at most BLOCK documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = [bitmaps.merge(x) for x in batch.column("parts").to_pylist()]
            docs = pa.array([bitmaps.popcount(bitmaps.either(p)) for p in planes], pa.int64())
            links = pa.array(map(bitmaps.total, planes), pa.int64())
            yield pa.record_batch([batch.column("pair"), batch.column("block"), pa.array(planes, pa.list_(pa.binary())), docs, links], names=["pair", "block", "planes", "docs", "links"])

    merged = parts.groupBy("pair", "block").agg(F.collect_list("planes").alias("parts"))
    return merged.mapInArrow(run, "pair long, block long, planes array<binary>, docs long, links long")


def pair_counts(index: DataFrame) -> DataFrame:
    """pair, a, b, docs, links, best (whether no pair of the same b has more links)."""
    sums = index.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    each = sums.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(_LOW)).alias("b"), "docs", "links")
    most = each.groupBy("b").agg(F.max("links").alias("most"))
    return each.join(most, "b").select("pair", "a", "b", "docs", "links", (F.col("links") == F.col("most")).alias("best"))


def returned(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """block, at, n_best, count_sum, doc_sum: the pairs' counts, carried along the postings to the documents and added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = None, np.zeros((4, bitmaps.BLOCK), np.int64)

        def close() -> pa.RecordBatch:
            at = np.flatnonzero(sums[3])
            return pa.record_batch([pa.array(np.full(len(at), of, np.int64)), pa.array(at, pa.int32()), *(pa.array(sums[k, at]) for k in range(3))], names=["block", "at", "n_best", "count_sum", "doc_sum"])

        for batch in batches:
            for block, planes, docs, links, best in zip(*(batch.column(c).to_pylist() for c in ("block", "planes", "docs", "links", "best"))):
                if block != of:
                    if of is not None:
                        yield close()
                    of = block
                    sums[:] = 0
                # A position is in a plane once.
                for k, plane in enumerate(planes):
                    at = bitmaps.positions(plane)
                    if best:
                        sums[0, at] += 1 << k
                    sums[1, at] += links << k
                    sums[2, at] += docs << k
                    sums[3, at] += 1
        if of is not None:
            yield close()

    known = small(pairs.select("pair", "docs", "links", "best"))
    scored = index.select("pair", "block", "planes").join(known, "pair").select("block", "planes", "docs", "links", "best")
    return scored.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, at int, n_best long, count_sum long, doc_sum long")


def report(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per document the numbers of the alignment; `doc_sum` adds up, over links, how many documents have the pair."""
    encoded = materialize(aligned(docs, a, b))
    index = materialize(inverted(postings(encoded)))
    pairs = materialize(pair_counts(index))
    sums = returned(index, pairs)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    own = encoded.select("block", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return own.join(sums, ["block", "at"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", zero("doc_sum"))
