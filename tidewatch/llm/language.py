"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of lower-cased letters, with the edge of a word as a letter of its own, hashed to 2**16
numbers. A text's features are their shares of its n-grams times the inverse document frequency, which is counted over all
rows to learn from. Weights are learnt with the follow-the-regularised-leader update (one learning rate a weight) and an
elastic net, whose first power leaves most weights at zero; a temperature is then fitted on learning rows that were left
out, so that scores are calibrated.

Learning takes a bounded sample, `sample` rows at most in expectation, shared evenly by the labels: within a label rows are
drawn by a hash of id and text, so a run repeats. Everything else, frequencies and predictions, covers all rows and whole
texts. A prediction depends on nothing but the text.

Defined results: texts that are null or have no letter give `und` and 0; without a row to learn from so do all. Rows with a
null label teach nothing. With one label only, every other text gets it. Repeated rows are predicted each. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, slices

ORDERS, DIMS = 3, 1 << 16
#: Shares are small numbers; this factor brings them to where the learning rate works.
SCALE = 100.0
_K = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for what is no letter; one table a worker."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                table[ord(c)] = ord(c.lower()[0])
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the features of all texts and the number of the text that each belongs to, ascending."""
    whole = "\n".join([t or "" for t in texts]) + "\n"
    letter = _lower()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")]
    row = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])
    gap = letter == 0
    keep = ~(gap & np.concatenate(([True], gap[:-1])))
    # One edge before the first word; others follow their words.
    c = np.concatenate(([0], letter[keep])).astype(np.uint64)
    row = np.concatenate(([0], row[keep]))
    full, out, h = c != 0, [], c
    for n in range(1, ORDERS + 1):
        if n > 1:
            h = h[:-1] * _K + c[n - 1 :]
        m = len(h)
        # Edges stand at the ends of an n-gram only, and one letter at least is in it.
        ok = full[:m].copy() if n == 1 else full[1 : 1 + m] | full[:m] if n == 2 else np.logical_and.reduce([full[k : k + m] for k in range(1, n - 1)])
        of = row[:m] if n == 1 else row[1 : 1 + m]
        # A word's first n-grams begin with the edge that follows the word before, maybe that of another text.
        out.append(((mix(h[ok] ^ np.uint64(n << 60)) >> np.uint64(64 - 16)).astype(np.int64), of[ok]))
    return out


def _per_text(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The features of each text."""
    found = [(f, np.searchsorted(r, np.arange(len(texts) + 1))) for f, r in grams(texts)]
    for i in range(len(texts)):
        yield np.concatenate([f[e[i] : e[i + 1]] for f, e in found])


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """In how many texts each feature is; tasks add up their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, flags = np.zeros(DIMS, np.int64), np.zeros(DIMS, bool)
        for batch in batches:
            for part in slices(batch):
                for f in _per_text(part.column("text").to_pylist()):
                    flags[f] = True
                    total += flags
                    flags[f] = False
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["f", "n"])

    out = np.zeros(DIMS, np.int64)
    sums = rows.select("text").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n"))
    for f, n in sums.collect():  # at most DIMS rows
        out[f] = n
    return out


@dataclass
class Settings:
    """alpha and beta of the learning rate, l1 and l2 of the elastic net, passes over the sample, its size, and the share that the temperature is fitted on."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.1
    passes: int = 4
    sample: int = 12_000
    held: float = 0.2


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMS + 1, 0)))  # the last row is the bias
    idf: np.ndarray = field(default_factory=lambda: np.zeros(DIMS))
    temperature: float = 1.0

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest label and its calibrated probability for each text."""
        n = len(texts)
        total, logits, known = np.zeros(n), np.zeros((n, len(self.labels))), self.weights[:DIMS] * (SCALE * self.idf)[:, None]
        letters = np.zeros(n, np.int64)
        for order, (f, r) in enumerate(grams(texts)):
            size = np.bincount(r, minlength=n)
            some = size > 0
            if len(f) and self.labels:
                logits[some] += np.add.reduceat(known[f], (np.cumsum(size) - size)[some])
            total += size
            letters = size if order == 0 else letters
        if not self.labels:
            return [("und", 0.0)] * n
        logits = (logits / np.maximum(total, 1)[:, None] + self.weights[DIMS]) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [(self.labels[b], float(p[i, b])) if letters[i] else ("und", 0.0) for i, b in enumerate(best.tolist())]


def learn(rows: Iterator[tuple[int, np.ndarray, np.ndarray]], n_labels: int, s: Settings) -> np.ndarray:
    """Weights from rows (label, features, values), each pass in the same order; the bias is feature DIMS."""
    z, n = np.zeros((DIMS + 1, n_labels)), np.zeros((DIMS + 1, n_labels))

    def weights(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= s.l1, 0.0, -(zz - np.sign(zz) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for label, at, x in rows:
        w = weights(at)
        logits = x @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p
        now = n[at]
        z[at] += g - (np.sqrt(now + g * g) - np.sqrt(now)) / s.alpha * w
        n[at] = now + g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits under which the labels are likeliest, by golden section over its logarithm."""
    if not len(labels) or logits.shape[1] < 2:
        return 1.0

    def loss(u: float) -> float:
        x = logits / math.exp(u)
        top = x.max(1)
        return float((top + np.log(np.exp(x - top[:, None]).sum(1)) - x[np.arange(len(labels)), labels]).mean())

    a, b, g = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def _vectors(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f = next(_per_text([text]))
    at, n = np.unique(f, return_counts=True)
    return np.append(at, DIMS), np.append(SCALE * idf[at] * n / max(1, len(f)), 1.0)


def train(rows: DataFrame, s: Settings = Settings()) -> Model:
    """The model of rows (doc_id, text, lang), all of which have a label."""
    per_label = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    counts = {r["lang"]: r["_n"] for r in per_label.collect()}  # a row a label
    labels = sorted(counts)
    if not labels:
        return Model([])
    df, n_rows = document_frequencies(rows), sum(counts.values())
    idf = np.where(df > 0, np.log((1 + n_rows) / (1 + df)) + 1, 0.0)
    each = math.ceil(s.sample / len(labels))
    even = lambda *c: F.xxhash64(*c) / F.lit(2.0**64) + 0.5  # noqa: E731  over [0, 1)
    known = F.broadcast(per_label) if len(labels) < 10_000 else per_label
    some = rows.join(known, "lang").where(even("doc_id", "text") < F.lit(float(each)) / F.col("_n")).select("lang", "text", even("text", "doc_id").alias("turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = []
        for batch in batches:
            for lang, text, turn in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "turn"))):
                drawn.append((turn, labels.index(lang), *_vectors(text, idf)))
        drawn.sort(key=lambda x: (x[0], x[1], len(x[2])))
        held = [x for x in drawn if x[0] < s.held]
        taught = [x[1:] for x in drawn if x[0] >= s.held]
        weights = learn((x for _ in range(s.passes) for x in taught), len(labels), s)
        t = temperature(np.array([v @ weights[at] for _, _, at, v in held]).reshape(len(held), len(labels)), np.array([x[1] for x in held], np.int64))
        at = np.flatnonzero(weights.any(1))
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(weights[at].tolist(), pa.list_(pa.float64())), pa.array(np.full(len(at), t))], names=["f", "w", "t"])

    model = Model(labels, np.zeros((DIMS + 1, len(labels))), idf)
    # One task learns from the sample, which `sample` bounds.
    for f, w, t in materialize(some.repartition(1).mapInArrow(run, "f int, w array<double>, t double")).collect():
        model.weights[f], model.temperature = w, t
    return model


def predict(docs: DataFrame, model: Model, *more: Column) -> DataFrame:
    """doc_id, the columns `more` (of fixed kind boolean), lang_pred and score of every row."""
    names = [f"m{i}" for i in range(len(more))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score = zip(*model.scores(part.column("text").to_pylist()))
                yield pa.record_batch([part.column("doc_id"), *(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", *names, "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[c.alias(n) for c, n in zip(more, names)])
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} boolean" for n in names), "lang_pred string", "score double"]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from rows that are not held out, predicted for all."""
    own = held_out(F.col("doc_id"))
    model = train(docs.where(~own & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), s)
    return predict(docs, model, own).withColumnRenamed("m0", "held_out").select("doc_id", "held_out", "lang_pred", "score")
