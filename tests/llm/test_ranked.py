"""Ranked search against scores computed one by one."""

import math
import re
from collections import Counter

import pytest

from tidewatch.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, rank int"


def brute(docs, items, k=10):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    bags = [(d, Counter(TERM.findall((t or "").translate(fold)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, all_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // all_terms
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in Counter(TERM.findall((text or "").translate(fold))).items() if t in b)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked.search(d, q, k).collect()), key=repr)


def test_sample_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    q = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked.search(d, q).collect()), key=repr)
    assert got == brute(d.collect(), q.collect())


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ranked, "LEAST_ROWS", 2)
    monkeypatch.setattr(ranked, "BUCKET_ENTRIES", 40)
    docs = [(1, "Alpha beta, GAMMA-gamma"), (2, None), (3, ""), (4, "--- !!"), (None, "alpha ÉTÉ été 42"), (5, "Alpha beta, GAMMA-gamma"), (5, "Alpha beta, GAMMA-gamma"), (6, "beta " * 3000 + "zebra"), (7, "alpha"), (8, "delta\x00alpha\x7fbeta ünï")]
    docs += [(100 + i, f"word{i % 7} beta filler{i} été") for i in range(60)]
    items = [(1, "alpha alpha beta"), (1, "gamma"), (None, "été"), (2, None), (3, "nothing-like-it"), (4, ""), (5, "zebra beta"), (6, "word3 filler3 word3")]
    assert found(spark, docs, items, 4) == brute(docs, items, 4)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 5)
    docs = [(i, " ".join(f"t{j}" for j in range(i % 9, i % 9 + 1 + i % 4))) for i in range(80)]
    items = [(i, f"t{i} t{i + 1} t{i}") for i in range(9)]
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([], [])])
def test_empty(spark, docs, items):
    assert found(spark, docs, items) == []


def test_bounds_lose_nothing():
    """Survivors hold every row that reaches the cosine, over random vectors with zeros."""
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.integers(0, 50, (200, 12)) * (rng.random((200, 12)) < 0.4)
    v = v[v.any(1)]
    norms = np.sqrt((v.astype(float) ** 2).sum(1))
    v, norms = v[np.argsort(-norms)], np.sort(norms)[::-1]
    ids = [np.flatnonzero(r) for r in v]
    b = ranked._Bucket(np.arange(len(v)), norms, ranked._starts(np.array([len(i) for i in ids])), np.concatenate(ids), v[v > 0], 12)
    pruned = 0
    for _ in range(200):
        q = np.unique(rng.integers(0, 12, 4))
        c = rng.integers(1, 4, len(q))
        n = np.sqrt((c.astype(float) ** 2).sum())
        cosine = float(rng.uniform(0.3, 1))
        rows = b.survivors(q, c / n, cosine)
        rows, scores = b.scores(q, c, rows, np.zeros(12, np.int64))
        exact = v[:, q] @ c
        assert (exact[rows] == scores).all()
        reach = set(np.flatnonzero(exact >= cosine * n * norms[0]))
        assert reach <= set(rows.tolist())
        pruned += len(v) - len(rows)
    assert pruned > 0
