"""Brown class-based bigram model.

Training counts every word of the training texts and puts every one of them into a class. The `exchanged` most
frequent words are exchanged in rounds: each round evaluates, for all of them at once, the gain in the likelihood of
the class bigrams if the word moved to another class, and moves half of the words (by parity of word and round); it
ends when neither half moves, or after `rounds`, and the best assignment of all rounds is used. Every other word then
goes to the class of the greatest gain by its neighbours' classes against that table (the first-order gain, linear in
the word's counts). The number of classes follows the vocabulary: its size to the power CLASS_POWER. The end of a text
is a class of its own and also precedes each text. Words seen once also count as an unknown word, before and after
their neighbours, which gives unknown words a class with transitions of its own. A token costs
log10 P(class | class before) + log10 P(word | class); both are proper distributions over the training vocabulary and
one unknown word.

Texts are split twice, for the counts and for their words' numbers, which are written. The at most LOOKUP most
frequent words have numbers (tables of 12 to 24 MiB at most, whatever the input); tokens beside any other word are joined
with the table of all words by shuffle, for the class bigrams and for the scores alike.

Defined results: null text counts as empty and has the end token only; a null
doc_id counts as the empty string for the fold; repeated rows are separate; other columns are not read; without
training tokens every count is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, materialize, mix_one, slices, text_bytes, words

LOOKUP = 1 << 20
#: Classes are the vocabulary's size to this power: 31 for 100,000 words, 91 for three million.
CLASS_POWER = 0.3
#: Tokens that one step inside a task handles at once.
STEP = 1 << 19
END = np.uint64(mix_one(0x0E4D0F7E87))


def held_out(folds: int = 7, fold: int = 2):
    """Whether crc32 of doc_id as text falls into the held-out fold."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == fold


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Document and hash of every word, lower-cased A-Z, and the number of texts."""
    data, starts, ends = text_bytes(col, sep=0x20)
    data = LOWER[data]
    ws, we = words(data)
    return np.searchsorted(starts, ws, "right") - 1, Rolling(data).spans(ws, we), len(starts)


def _sum_by(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)


def count_words(train: DataFrame) -> DataFrame:
    """w (hash), n over all training texts, the end token included; counts are combined inside each task first."""

    def run(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            for part in slices(batch):
                _, h, n = _tokens(part.column("text"))
                k, c = np.unique(h, return_counts=True)
                keys += [k, np.array([END])]
                counts += [c, np.array([n])]
                held += len(k)
                if held > 1_500_000:
                    k, c = _sum_by(keys, counts)
                    keys, counts, held = [k], [c], len(k)
                    if held > 1_000_000:
                        yield out(k, c)
                        keys, counts, held = [], [], 0
        if keys:
            yield out(*_sum_by(keys, counts))

    def out(k, c):
        return pa.record_batch([pa.array(k.view(np.int64)), pa.array(c)], names=["w", "n"])

    return train.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The numbered words, the most frequent ones: number 0 is the most frequent; and the totals."""

    by_rank: np.ndarray
    counts: np.ndarray
    least: int
    ends: int
    total: int
    types: int

    @property
    def complete(self) -> bool:
        return len(self.by_rank) + (self.ends > 0) == self.types


LEVEL = "floor(ln(n) * 16)"


def frequent(counts: DataFrame, limit: int) -> Words:
    """The words above the lowest count level (sixteenths of a natural logarithm) at which at most `limit` remain."""
    levels = {r["l"]: r for r in counts.groupBy(F.expr(LEVEL).alias("l")).agg(F.count("*").alias("v"), F.sum("n").alias("s")).collect()}
    kept, least = 0, 1 << 20
    for l in sorted(levels, reverse=True):
        if kept + levels[l]["v"] > limit:
            break
        kept, least = kept + levels[l]["v"], l
    end = int(END.astype(np.int64))
    rows = counts.where((F.expr(LEVEL) >= least) & (F.col("w") != end)).select("w", "n").toArrow()
    h, n = rows["w"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.lexsort((h, -n))
    ends = counts.where(F.col("w") == end).first()
    return Words(h[order], n[order], least, ends["n"] if ends else 0, sum(r["s"] for r in levels.values()), sum(r["v"] for r in levels.values()))


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def numbered(docs: DataFrame, table: Words) -> DataFrame:
    """rid, doc_id, held_out, ids and rare, written: the words' numbers (one past the last for other words), and these words' hashes in order, unless the table is complete."""
    order = np.argsort(table.by_rank)
    shared = docs.sparkSession.sparkContext.broadcast((table.by_rank[order], order.astype(np.int32)))
    size, complete = len(order), table.complete

    def run(batches):
        hashes, numbers = shared.value
        for batch in batches:
            for part in slices(batch):
                doc, h, n = _tokens(part.column("text"))
                u, inverse = np.unique(h, return_inverse=True)
                number = np.full(len(u), size, np.int32)
                if size:
                    at = np.minimum(np.searchsorted(hashes, u), size - 1)
                    number = np.where(hashes[at] == u, numbers[at], size).astype(np.int32)
                ids = number[inverse]
                miss = np.zeros(0, np.int64) if complete else np.flatnonzero(ids == size)
                of = lambda d: np.searchsorted(d, np.arange(n + 1))
                columns = [part.column("doc_id").cast(pa.int64()), part.column("held_out"), _lists(ids, of(doc), pa.int32()), _lists(h[miss].view(np.int64), of(doc[miss]), pa.int64())]
                yield pa.record_batch(columns, names=["doc_id", "held_out", "ids", "rare"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, ids array<int>, rare array<long>")
    return materialize(rows.withColumn("rid", F.monotonically_increasing_id()))


def parts(batches):
    """Numbered rows in steps of about STEP tokens; one row is never cut."""
    for batch in batches:
        step = np.cumsum(np.asarray(pc.list_value_length(batch.column("ids")), np.int64) + 1) // STEP
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def sequence(part: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of each token, `end` after each row's last, and each token's predecessor (`end` before a row)."""
    many = np.asarray(pc.list_value_length(part.column("ids")), np.int64) + 1
    row = np.repeat(np.arange(len(many)), many)
    seq = np.full(len(row), end, np.int64)
    last = np.zeros(len(row), bool)
    last[np.cumsum(many) - 1] = True
    seq[~last] = part.column("ids").flatten().to_numpy()
    return row, seq, np.concatenate(([end], seq[:-1]))


def count_bigrams(train: DataFrame, k: int) -> DataFrame:
    """a, b, n for neighbours among the first k words, k for the end and k + 1 for all others; a task keeps one dense table of them."""
    wide = k + 2

    def run(batches):
        table = np.zeros(wide * wide, np.int64)
        for part in parts(batches):
            _, seq, before = sequence(part, -1)
            of = lambda x: np.where(x < 0, k, np.where(x < k, x, k + 1))
            table += np.bincount(of(before) * wide + of(seq), minlength=wide * wide)
        some = np.flatnonzero(table)
        yield pa.record_batch([pa.array(some // wide), pa.array(some % wide), pa.array(table[some])], names=["a", "b", "n"])

    return train.select("ids").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def objective(t: np.ndarray) -> float:
    """Log likelihood of the class bigrams, up to what no assignment changes."""
    return float(_xlogx(t).sum() - _xlogx(t.sum(0)).sum() - _xlogx(t.sum(1)).sum())


def gains(left: np.ndarray, right: np.ndarray, own: float, g: int, t: np.ndarray, classes: int) -> np.ndarray:
    """Objective after moving a word from class g to each class, less that of its own class.

    left[c] counts class c before the word, right[c] after it, `own` the word before itself.
    """
    out = np.empty(classes)
    rest = t.copy()  # counts without the word
    rest[:, g] -= left
    rest[g, :] -= right
    rest[g, g] += own
    lo, hi = left.copy(), right.copy()
    lo[g] -= own
    hi[g] -= own
    rows, cols = rest.sum(1), rest.sum(0)
    # Only row c, column c and cell (c, c) differ between the targets.
    base_r, base_c = _xlogx(rest), (_xlogx(rows), _xlogx(cols))
    for c in range(classes):
        row, col = rest[c, :] + hi, rest[:, c] + lo
        corner = rest[c, c] + lo[c] + hi[c] + own
        delta = _xlogx(row).sum() - base_r[c, :].sum() + _xlogx(col).sum() - base_r[:, c].sum()
        delta += _xlogx(corner) - _xlogx(row[c]) - _xlogx(col[c]) + base_r[c, c]
        new_rows, new_cols = rows + lo, cols + hi
        new_rows[c] = rows[c] + lo[c] + hi.sum() + own
        new_cols[c] = cols[c] + hi[c] + lo.sum() + own
        delta -= _xlogx(new_rows).sum() - base_c[0].sum() + _xlogx(new_cols).sum() - base_c[1].sum()
        out[c] = delta
    return out - out[g]


def exchange(bigrams: DataFrame, k: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of every number (words, end, others) and the class bigram table of the best round; ends when neither half moves."""
    spark = bigrams.sparkSession
    classes = max(1, min(classes, k))
    cls = np.concatenate([np.arange(k) % classes, [classes, classes + 1]])
    wide = classes + 2
    best, still = None, 0
    for turn in range(rounds + 1):
        of = cls.copy()

        def contexts(batches, of=of):
            table = np.zeros((k + 2) * 2 * wide, np.int64)
            loops = np.zeros(k + 2, np.int64)
            for batch in batches:
                a, b, n = (np.asarray(c) for c in batch.columns)
                table += np.bincount(b * 2 * wide + of[a], weights=n, minlength=len(table)).astype(np.int64)
                table += np.bincount(a * 2 * wide + wide + of[b], weights=n, minlength=len(table)).astype(np.int64)
                loops += np.bincount(a[a == b], weights=n[a == b], minlength=k + 2).astype(np.int64)
            some = np.flatnonzero(table)
            w, slot = some // (2 * wide), some % (2 * wide)
            yield pa.record_batch([pa.array(w), pa.array(slot), pa.array(table[some])], names=["w", "slot", "n"])
            some = np.flatnonzero(loops)
            yield pa.record_batch([pa.array(some), pa.array(np.full(len(some), 2 * wide)), pa.array(loops[some])], names=["w", "slot", "n"])

        near = bigrams.mapInArrow(contexts, "w long, slot long, n long").groupBy("w", "slot").agg(F.sum("n").alias("n"))
        near = near.groupBy("w").agg(F.collect_list(F.struct("slot", "n")).alias("c"))  # at most 2 x (classes + 2) + 1 slots
        near = materialize(near)

        def rows_of(batches, of=of):
            table = np.zeros(wide * wide, np.int64)
            for batch in batches:
                for w, c in zip(batch.column("w").to_pylist(), batch.column("c").to_pylist()):
                    for x in c:
                        if wide <= x["slot"] < 2 * wide:
                            table[of[w] * wide + x["slot"] - wide] += x["n"]
            some = np.flatnonzero(table)
            yield pa.record_batch([pa.array(some), pa.array(table[some])], names=["cell", "n"])

        t = np.zeros(wide * wide)
        for r in near.mapInArrow(rows_of, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            t[r["cell"]] = r["n"]
        t = t.reshape(wide, wide)
        value = objective(t)
        if best is None or value > best[0]:
            best = (value, cls.copy(), t)
        if turn == rounds:
            break

        def moves(batches, of=of, t=t, turn=turn):
            for batch in batches:
                out = []
                for w, c in zip(batch.column("w").to_pylist(), batch.column("c").to_pylist()):
                    if w >= k or (w + turn) % 2:
                        continue
                    v = np.zeros(2 * wide + 1)
                    for x in c:
                        v[x["slot"]] += x["n"]
                    gain = gains(v[:wide], v[wide : 2 * wide], v[-1], int(of[w]), t, classes)
                    to = int(gain.argmax())
                    if gain[to] > 1e-9:
                        out.append((w, to))
                w, to = zip(*out) if out else ((), ())
                yield pa.record_batch([pa.array(w, pa.int64()), pa.array(to, pa.int64())], names=["w", "c"])

        moved = near.mapInArrow(moves, "w long, c long").collect()
        still = 0 if moved else still + 1
        if still == 2:
            break
        for r in moved:
            cls[r["w"]] = r["c"]
    return best[1], best[2]


def neighbours(train: DataFrame, table: Words, cls: np.ndarray, k: int) -> DataFrame:
    """w, slot, n for the words beyond the first k: slot is the class before, or `wide` more than the class after; combined inside each task first."""
    wide = int(cls.max()) + 1
    shared = train.sparkSession.sparkContext.broadcast(table.by_rank)
    size = len(table.by_rank)

    def out(w, slot, n):
        return pa.record_batch([pa.array(w.view(np.int64)), pa.array(slot.astype(np.int32), pa.int32()), pa.array(n.astype(np.int64))], names=["w", "slot", "n"])

    def split(key, n):
        return out(shared.value[key // (2 * wide)], key % (2 * wide), n)

    def run(batches):
        keys, counts, held = [], [], 0
        for part in parts(batches):
            _, seq, before = sequence(part, -1)
            of = lambda x: cls[np.where(x < 0, k, np.where(x < k, x, k + 1))]
            classes = of(seq)
            at = np.flatnonzero(seq >= k)  # the end of its text follows the last word
            left, right = of(before[at]), classes[at + 1] + wide
            rare = seq[at] == size
            w = part.column("rare").flatten().to_numpy().view(np.uint64)
            if len(w):
                yield out(np.tile(w, 2), np.concatenate((left[rare], right[rare])), np.ones(2 * len(w)))
            own = seq[at][~rare] * 2 * wide
            key, n = np.unique(np.concatenate((own + left[~rare], own + right[~rare])), return_counts=True)
            keys, counts, held = [*keys, key], [*counts, n], held + len(key)
            if held > 3_000_000:
                key, n = _sum_by(keys, counts)
                keys, counts, held = [key], [n], len(key)
                if held > 2_000_000:
                    yield split(key, n)
                    keys, counts, held = [], [], 0
        if keys:
            yield split(*_sum_by(keys, counts))

    return train.select("ids", "rare").mapInArrow(run, "w long, slot int, n long")


def smoothed(t: np.ndarray) -> np.ndarray:
    """P(class | class before): one pseudo-count a class before, spread as the classes are."""
    share = (t.sum(0) + 1) / (t.sum() + len(t))
    return (t + share) / (t.sum(1, keepdims=True) + 1)


def place(near: DataFrame, t: np.ndarray) -> DataFrame:
    """w, n, c: the class of the greatest first-order gain of each word, and its count.

    A word of counts `left` and `right` adds to the objective, to first order, the sums of log(t[l, c] / column c) over its
    left and log(t[c, r] / row c) over its right neighbours, less what does not depend on c. The end is no word's class.
    """
    wide = len(t)
    before = np.log(smoothed(t)) - np.log(t.sum(0) + 1)
    after = np.log(smoothed(t)).T
    slots = near.repartition("w").groupBy("w", "slot").agg(F.sum("n").alias("n")).groupBy("w").agg(F.collect_list(F.struct("slot", "n")).alias("c"))  # at most 2 x classes

    def run(batches):
        free = np.delete(np.arange(wide), wide - 2)
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                flat = part.column("c").flatten()
                slot, n = (flat.field(j).to_numpy() for j in range(2))
                row = np.repeat(np.arange(len(part)), np.asarray(pc.list_value_length(part.column("c"))))
                v = np.bincount(row * 2 * wide + slot, weights=n, minlength=len(part) * 2 * wide).reshape(-1, 2 * wide)
                gain = v[:, :wide] @ before[:, free] + v[:, wide:] @ after[:, free]
                yield pa.record_batch([part.column("w"), pa.array(v[:, :wide].sum(1).astype(np.int64)), pa.array(free[gain.argmax(1)].astype(np.int32))], names=["w", "n", "c"])

    return slots.mapInArrow(run, "w long, n long, c int")


@dataclass
class Model:
    """Classes: 0 to classes - 1, the end, the class in which words start that are not exchanged, the unknown word."""

    words: Words
    #: Of each number: class x 2, and 1 more for a word seen once; then the unknown word and the end.
    marks: np.ndarray
    log_step: np.ndarray
    log_class: np.ndarray

    @property
    def unknown(self) -> int:
        return len(self.log_class) - 1

    def emission(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words with training count n; the unknown word (0) has its class to itself."""
        return np.where(n > 0, np.log10(np.maximum(n, 1)) - self.log_class[c], 0.0)


def beyond(rows: DataFrame, marks: np.ndarray, known: DataFrame) -> DataFrame:
    """rid, held_out, a, b, n, written: the marks of neighbours of which one has no number, and the count of the second one (null if it has a number).

    Words of no number are joined with the table of all words; those it does not hold are unknown.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(marks)
    size = len(marks) - 2

    def run(batches):
        for part in parts(batches):
            row, seq, before = sequence(part, size + 1)
            hidden = seq == size
            w = np.zeros(len(seq), np.int64)
            w[hidden] = part.column("rare").flatten().to_numpy()
            first = before == size
            wa = np.where(first, np.concatenate(([0], w[:-1])), 0)
            at = np.flatnonzero(hidden | first)
            mark = lambda x, hide: pa.array(shared.value[x[at]].astype(np.int32), pa.int32(), mask=hide[at])
            key = lambda x, hide: pa.array(x[at], pa.int64(), mask=~hide[at])
            columns = [part.column("rid").take(pa.array(row[at])), part.column("held_out").take(pa.array(row[at])), mark(before, first), mark(seq, hidden), key(wa, first), key(w, hidden)]
            yield pa.record_batch(columns, names=["rid", "held_out", "a", "b", "wa", "wb"])

    some = rows.where(F.size("rare") > 0).select("rid", "held_out", "ids", "rare")
    each = materialize(some.mapInArrow(run, "rid long, held_out boolean, a int, b int, wa long, wb long"))
    none = int(marks[size])
    of = lambda x: known.select(F.col("w").alias(f"w{x}"), F.col("n").alias(f"n{x}"), (F.col("c") * 2 + (F.col("n") == 1).cast("int")).alias(f"m{x}"))
    found = lambda x: F.coalesce(f"m{x}", F.lit(none))
    # Rows without a word on a side do not pass that side's join, so that nulls form no hot key.
    firsts = each.where("wa is not null").join(of("a"), "wa", "left").withColumn("a", found("a")).drop("wa", "na", "ma")
    firsts = firsts.unionByName(each.where("wa is null").drop("wa"))
    seconds = firsts.where("wb is not null").join(of("b"), "wb", "left").select("rid", "held_out", "a", found("b").alias("b"), F.coalesce("nb", F.lit(0)).alias("n"))
    return materialize(seconds.unionByName(firsts.where("wb is null").select("rid", "held_out", "a", "b", F.lit(None).cast("long").alias("n"))))


def _counted(table: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> None:
    """Add pairs of marks to a class table; a word seen once counts for its class and for the unknown word."""
    wide = len(table)
    for x, once_a in ((a // 2, a >= 0), (np.full_like(a, wide - 1), a % 2 == 1)):
        for y, once_b in ((b // 2, b >= 0), (np.full_like(b, wide - 1), b % 2 == 1)):
            use = once_a & once_b
            table += np.bincount(x[use] * wide + y[use], weights=None if n is None else n[use], minlength=wide * wide).reshape(wide, wide).astype(table.dtype)


def class_bigrams(train: DataFrame, marks: np.ndarray, wide: int, complete: bool) -> np.ndarray:
    """Class bigrams of all neighbours that have numbers."""
    shared = train.sparkSession.sparkContext.broadcast(marks)
    size = len(marks) - 2

    def run(batches):
        table = np.zeros((wide, wide), np.int64)
        for part in parts(batches):
            _, seq, before = sequence(part, size + 1)
            use = np.full(len(seq), True) if complete else (seq != size) & (before != size)
            _counted(table, shared.value[before[use]], shared.value[seq[use]])
        some = np.flatnonzero(table)
        yield pa.record_batch([pa.array(some), pa.array(table.ravel()[some])], names=["cell", "n"])

    t = np.zeros(wide * wide)
    for r in train.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        t[r["cell"]] = r["n"]
    return t.reshape(wide, wide)


def train(docs: DataFrame, exchanged: int = 2048, classes: int | None = None, rounds: int = 12, lookup: int = LOOKUP) -> tuple[Model, DataFrame, DataFrame, DataFrame | None]:
    """The model, learnt from the rows of `docs` that are not held out; the numbered rows; all words (w, n, c); and the neighbours that the numbers do not tell."""
    spark = docs.sparkSession
    table = frequent(materialize(count_words(docs.where(~held_out()))), lookup)
    rows = numbered(docs, table)
    seen = rows.where(~F.col("held_out"))
    k = min(exchanged, len(table.by_rank))
    cls, t = exchange(materialize(count_bigrams(seen, k)), k, classes or max(2, round(table.types**CLASS_POWER)), rounds)
    placed = place(neighbours(seen, table, cls, k), t)
    top = spark.createDataFrame(pa.table({"w": table.by_rank[:k].view(np.int64), "n": table.counts[:k], "c": cls[:k].astype(np.int32)})) if k else None
    known = materialize(placed.unionByName(top) if k else placed)
    wide = len(t) + 1
    size = len(table.by_rank)
    marks = np.zeros(size + 2, np.int64)
    held = known.where(F.expr(LEVEL) >= table.least).select("w", "c").toArrow()  # at most `lookup` words
    order = np.argsort(table.by_rank)
    if size:
        marks[order[np.searchsorted(table.by_rank[order], held["w"].to_numpy().view(np.uint64))]] = held["c"].to_numpy() * 2
    marks[:size] += table.counts == 1
    marks[size:] = (wide - 1) * 2, (wide - 3) * 2
    t = class_bigrams(seen, marks, wide, table.complete)
    late = None
    if not table.complete:
        late = beyond(rows, marks, known)
        more = late.where(~F.col("held_out")).groupBy("a", "b").agg(F.count("*").alias("n")).toPandas()  # at most (2 x classes) squared
        _counted(t, more["a"].to_numpy(np.int64), more["b"].to_numpy(np.int64), more["n"].to_numpy())
    # The column of the unknown word counts words that are in their own classes as well.
    return Model(table, marks, np.log10(smoothed(t)), np.log10(np.maximum(t[:-1].sum(0), 1))), rows, known, late


def score(model: Model, rows: DataFrame, late: DataFrame | None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every numbered row."""
    spark, w = rows.sparkSession, model.words
    shared = spark.sparkContext.broadcast(model)
    under = float(np.log10(w.total + w.types + 1))
    size, complete = len(w.by_rank), w.complete

    def run(batches):
        m = shared.value
        counts = np.concatenate((m.words.counts, [0, m.words.ends]))
        classes = m.marks // 2
        emission = m.emission(classes, counts)
        emission[size + 1] = 0.0
        base_of = np.log10(counts + 1.0) - under
        for part in parts(batches):
            n = len(part)
            row, seq, before = sequence(part, size + 1)
            own = np.full(len(seq), True) if complete else seq != size
            both = own if complete else own & (before != size)
            add = lambda use, x: np.bincount(row[use], weights=x[seq[use]], minlength=n)
            step = np.bincount(row[both], weights=m.log_step[classes[before[both]], classes[seq[both]]], minlength=n)
            columns = [part.column("rid"), part.column("doc_id"), part.column("held_out"), pa.array(np.bincount(row, minlength=n))]
            columns += [pa.array(add(own, (counts > 0).astype(float)).astype(np.int64)), pa.array(add(own, base_of)), pa.array(step + add(own, emission))]
            yield pa.record_batch(columns, names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    done = rows.select("rid", "doc_id", "held_out", "ids").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    if late is not None:
        wide = len(model.log_class)
        a, b = np.divmod(np.arange(wide * wide), wide)
        steps = spark.createDataFrame(pa.table({"ca": a, "cb": b, "step": model.log_step.ravel(), "of": model.log_class[b]}))
        each = late.select("rid", "n", F.shiftright("a", 1).cast("long").alias("ca"), F.shiftright("b", 1).cast("long").alias("cb")).join(F.broadcast(steps), ["ca", "cb"])
        more = each.groupBy("rid").agg(
            F.sum((F.col("n") > 0).cast("long")).alias("k"),
            F.sum(F.log10(F.col("n") + 1) - under).alias("b"),
            F.sum(F.col("step") + F.when(F.col("n") > 0, F.log10("n") - F.col("of")).otherwise(0.0)).alias("s"),
        )
        add = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0))
        done = done.join(more, "rid", "left").withColumns({"n_known": add("n_known", "k"), "base": add("base", "b"), "score": add("score", "s")})
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(w.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def train_and_score(docs: DataFrame, **options) -> DataFrame:
    model, rows, _, late = train(docs, **options)
    return score(model, rows, late)
