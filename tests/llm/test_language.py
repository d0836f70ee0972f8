"""Language identification: features against a plain version, learning, calibration, held-out accuracy and odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import language

SCHEMA = "doc_id long, text string, lang string, score string"


def plain_grams(text):
    """The n-grams of a text in letters, counted one by one."""
    words, word = [], ""
    for c in text or "":
        if c.isalpha():
            word += c.lower()[0]
        elif word:
            words.append(word)
            word = ""
    words += [word] if word else []
    out = Counter()
    for w in words:
        padded = " " + w + " "
        out.update(w)
        for n in (2, 3):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


@pytest.mark.parametrize("texts", [["Hello, wörld! x", "", None, "ab", "...", "Éa b1c", "日本 語", "a"], ["ab", "cd ef"], ["--- x ---", " y"]])
def test_features(texts):
    """As many features of each count as n-grams, and equal features for equal n-grams."""
    alone = [sorted(next(language._per_text([t])).tolist()) for t in texts]
    together = [sorted(f.tolist()) for f in language._per_text(texts)]
    assert alone == together
    for t, f in zip(texts, alone):
        assert sorted(Counter(f).values()) == sorted(plain_grams(t).values())


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = d.select("doc_id", "lang").join(language.identify(d), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang"] == r["lang_pred"] for r in held) / len(held)
    assert right >= 0.95, right
    assert abs(sum(r["score"] for r in held) / len(held) - right) < 0.05  # calibrated


def test_labels_do_not_reach_predictions(spark):
    """Held-out labels, sources and ids of equal texts change nothing."""
    words = {"x": "aba bab abba", "y": "cdc dcd cddc"}
    rows = [(i, f"{words['xy'[i % 2]]} {words['xy'[i % 2]][: i % 7]}", "xy"[i % 2]) for i in range(80)]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    a = language.identify(spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)).collect()
    b = language.identify(spark.createDataFrame([(i, t, "z" if (i, t, l) in held else l, "q") for i, t, l in rows], SCHEMA)).collect()
    assert sorted(a) == sorted(b)
    assert all(r["lang_pred"] == "xy"[r["doc_id"] % 2] for r in a)


def test_odd_rows(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the cat sat", "on the mat"] * 4)] + [(20 + i, t, "fr") for i, t in enumerate(["le chat est là", "sur la table été"] * 4)]
    odd = [(100, None, "en"), (101, "", "fr"), (102, "12 34 ...", "en"), (None, "the the", None), (None, "le la", "fr"), (103, "the cat " * 40_000, None), (103, "the cat " * 40_000, None), (104, "l'été", None), (105, "日本語", None)]
    got = language.identify(spark.createDataFrame([(*r, "s") for r in rows + odd], SCHEMA)).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        if r["doc_id"] in (100, 101, 102):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr") and 0 <= r["score"] <= 1
    long = [r for r in got if r["doc_id"] == 103]
    assert long[0] == long[1] and long[0]["lang_pred"] == "en"
    assert not [r for r in got if r["doc_id"] is None and r["held_out"]]


@pytest.mark.parametrize("rows", [[], [(1, "abc", None)], [(1, "abc", "en"), (3, "d", None)]])
def test_few_rows(spark, rows):
    got = language.identify(spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)).collect()
    learns = any(l and zlib.crc32(str(i).encode()) % 4 != 2 for i, _, l in rows)
    assert [r["lang_pred"] for r in got] == ["en" if learns else "und"] * len(rows)


def test_elastic_net_and_temperature():
    rng = np.random.default_rng(0)
    rows = [(int(i % 2), np.array([i % 2, 5 + rng.integers(50), language.DIMS]), np.array([1.0, 0.1, 1.0])) for i in range(400)]
    w = language.learn(iter(rows * 3), 2, language.Settings())
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and not w[5:55].any()
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=np.exp(x / 2) / np.exp(x / 2).sum()) for x in logits])
    assert abs(language.temperature(logits, labels) - 2) < 0.4


def test_sample_is_bounded(spark):
    rows = [(i, "abc def" if i % 2 else "xyz uvw", "a" if i % 2 else "x") for i in range(600)]
    got = language.identify(spark.createDataFrame([(*r, "s") for r in rows], SCHEMA), language.Settings(sample=100)).collect()
    assert all(r["lang_pred"] == ("a" if r["doc_id"] % 2 else "x") for r in got)
