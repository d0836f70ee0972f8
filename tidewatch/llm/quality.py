"""Quality rules under weak supervision.

Each rule looks at counts of one text and votes bad (-1), good (+1) or abstains
(0). Documents with equal votes are alike to the model, so expectation-
maximisation runs on the histogram of vote patterns (at most 3**rules rows,
counted over all documents). It estimates, for good and for bad documents, how
often each rule votes which way, and from that the posterior probability that a
document is good, which replaces the usual rule that all tests must pass.

Defined results: null and empty texts have no words and fail the base test; an
empty table gives an empty result; other columns are carried by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Rolling, materialize, mix, slices, text_bytes, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaim", "n_bare", "n_closed")
RULES = ("symbols", "repeats", "same_lines", "shouting", "exclaiming", "separators", "plain", "sentences")


@dataclass(frozen=True)
class Thresholds:
    """Shares beyond which a rule votes."""

    min_words: int = 50
    base_repeat: float = 0.5
    symbols: float = 0.1
    repeats: float = 0.3
    same_lines: float = 0.3
    shouting: float = 0.5
    exclaiming: float = 0.2
    separators: float = 0.2
    iterations: int = 100
    keep_from: float = 0.5


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _BANG = _lut(b"#*$%&|<>"), _lut(bytes(range(65, 91))), _lut(b"!")
_LETTER = _lut(bytes([*range(65, 91), *range(97, 123)]))
_WORDY = _lut(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
_FIRST = _lut(bytes([*range(0, 128), *range(192, 256)]))  # the first byte of a code point
_CLOSE = _lut(b'.!?:;"')


def counts(col: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text of a column."""
    data, starts, ends = text_bytes(col, sep=0x0A)
    n, roll = len(starts), Rolling(data)

    def per_doc(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag)))
        return total[ends] - total[starts]

    ws, we = words(data)
    doc = np.searchsorted(starts, ws, "right") - 1
    out = {"n_words": np.bincount(doc, minlength=n)}
    out["word_chars"] = per_doc(_FIRST[data] & ~WHITE[data])
    for name, lut in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_exclaim", _BANG)):
        out[name] = per_doc(lut[data])
    wordy = np.concatenate(([0], np.cumsum(_WORDY[data])))
    out["n_bare"] = np.bincount(doc[wordy[we] == wordy[ws]], minlength=n)
    # Lines: every text ends at a separator, which closes its last line.
    le = np.flatnonzero(data == 0x0A)
    ls = np.concatenate(([0], le[:-1] + 1)) if len(le) else le
    last = np.maximum.accumulate(np.where(WHITE[data], -1, np.arange(len(data)))) if len(data) else np.zeros(0, int)
    full = (last[le] >= ls) if len(le) else np.zeros(0, bool)
    ls, le = ls[full], le[full]
    line_doc = np.searchsorted(starts, ls, "right") - 1
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    key = mix(roll.spans(ls, le) + line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_doc[np.unique(key, return_index=True)[1]], minlength=n)
    out["n_closed"] = np.bincount(line_doc[_CLOSE[data[last[le]]]], minlength=n)
    # Windows of three words, told apart by document.
    h, cover = roll.spans(ws, we), np.zeros(len(ws), bool)
    if len(ws) > 2:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        three = mix(mix(h[at] + doc[at].astype(np.uint64)) * np.uint64(3) + mix(h[at + 1] + np.uint64(1)) * np.uint64(5) + h[at + 2])
        _, inverse, many = np.unique(three, return_inverse=True, return_counts=True)
        at = at[many[inverse] > 1]
        for k in range(3):
            cover[at + k] = True
    out["n_repeat_words"] = np.bincount(doc[cover], minlength=n)
    return out


def votes(c: dict[str, np.ndarray], t: Thresholds) -> np.ndarray:
    """Documents x RULES of -1, 0 and 1."""
    share = lambda a, b: c[a] / np.maximum(c[b], 1)
    sym, rep, same = share("n_symbols", "n_words"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")
    up, bang, bare, closed = share("n_upper", "n_letters"), share("n_exclaim", "n_words"), share("n_bare", "n_words"), share("n_closed", "n_lines")
    mean = share("word_chars", "n_words")
    v = np.zeros((len(sym), len(RULES)), np.int8)
    for k, (x, most) in enumerate(((sym, t.symbols), (rep, t.repeats), (same, t.same_lines), (up, t.shouting), (bang, t.exclaiming), (bare, t.separators))):
        v[x > most, k] = -1
    calm = (sym < t.symbols / 2) & (up < t.shouting / 2) & (bang < t.exclaiming / 2) & (bare < t.separators / 2) & (mean > 2) & (mean < 15)
    v[calm, 6] = 1
    v[(closed >= 0.5) & (rep < t.repeats / 2), 7] = 1
    v[(closed < 0.1) & (c["n_lines"] > 3), 7] = -1
    return v


def base_failed(c: dict[str, np.ndarray], t: Thresholds) -> np.ndarray:
    return (c["n_words"] < t.min_words) | (c["n_repeat_words"] > t.base_repeat * c["n_words"])


def fit(patterns: dict[str, int], t: Thresholds) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """Posterior probability of being good per vote pattern, and what was learnt of each rule."""
    if not patterns:
        return {}, {}
    keys = sorted(patterns)
    v = np.array([[ord(ch) - ord("0") for ch in k] for k in keys])  # 0 bad, 1 abstain, 2 good
    n = np.array([patterns[k] for k in keys], float)
    good = np.where((v == 0).any(1), 0.1, 0.9)
    one = np.eye(3)[v]  # pattern, rule, vote
    prior = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])  # a vote is rather right than wrong
    for _ in range(t.iterations):
        w = np.stack([n * (1 - good), n * good])
        table = np.einsum("cp,prv->crv", w, one) + prior[:, None, :]
        table /= table.sum(2, keepdims=True)
        share = (w.sum(1) + 1) / (w.sum() + 2)
        log = np.log(share)[:, None] + np.einsum("crv,prv->cp", np.log(table), one)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    learnt = {r: {"bad_when_bad": table[0, k, 0], "bad_when_good": table[1, k, 0], "good_when_bad": table[0, k, 2], "good_when_good": table[1, k, 2]} for k, r in enumerate(RULES)}
    return dict(zip(keys, good.tolist())), learnt


def _patterns(v: np.ndarray) -> list[str]:
    return ["".join(map(str, row)) for row in (v + 1).tolist()]


def measure(docs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """doc_id, COUNTS, base_failed and the vote pattern (one digit per rule: 0 bad, 1 abstain, 2 good)."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, votes string"

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                c = counts(part.column("text"))
                cols = [part.column("doc_id").cast(pa.int64()), *(pa.array(c[k], pa.int64()) for k in COUNTS), pa.array(base_failed(c, t)), pa.array(_patterns(votes(c, t)), pa.string())]
                yield pa.record_batch(cols, names=["doc_id", *COUNTS, "base_failed", "votes"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def histogram(measured: DataFrame) -> dict[str, int]:
    """Documents per vote pattern, of those that pass the base test."""
    return {r["votes"]: r["n"] for r in measured.where(~F.col("base_failed")).groupBy("votes").agg(F.count("*").alias("n")).collect()}


def judge(docs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Counts, votes, posterior and verdict per document. The counts are written once, since the model needs them all first."""
    measured = materialize(measure(docs, t))
    good, _ = fit(histogram(measured), t)
    rows = docs.sparkSession.createDataFrame(list(good.items()), "votes string, p_good double")
    return measured.join(rows, "votes", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= t.keep_from)).alias("kept"),
        "p_good", "votes",
    )


def keep_good(docs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The documents that the model keeps, with all their columns; two passes over the texts and no shuffle of them."""
    good, _ = fit(histogram(measure(docs, t)), t)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                c = counts(part.column("text").cast(pa.string()))
                keep = [p >= t.keep_from for p in (good.get(x, 0.0) for x in _patterns(votes(c, t)))]
                yield part.filter(pa.array(np.array(keep, bool) & ~base_failed(c, t)))

    return docs.mapInArrow(run, docs.schema)
