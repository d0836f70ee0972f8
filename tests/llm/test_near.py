import random

import numpy as np
import pytest

from tidewatch.llm import near


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets, up = [shingle_set(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (texts[i] or "") == (texts[j] or "") or (a and b and len(a & b) >= 0.8 * len(a | b)):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    texts = ["", None, "", "one", "One", "two words", "four words in all", "four words in all"]
    for _ in range(25):
        base = [word() for _ in range(r.randint(6, 300))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_match_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in near.classes(docs).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == brute(texts)
    kept = {r["doc_id"] for r in near.keep_one(docs).collect()}
    assert kept == set(brute(texts)) == {i for i, r in got.items() if r["kept"]}


def test_signature_estimates_weighted_similarity():
    r = np.random.default_rng(1)
    shared, own = r.integers(0, 2**63, 300, dtype=np.uint64), r.integers(0, 2**63, 100, dtype=np.uint64)
    a, b = np.concatenate([shared, own[:50]]), np.concatenate([shared, own[50:]])
    wa, wb = np.full(350, 2), np.concatenate([np.full(300, 1), np.full(50, 2)])
    doc = np.repeat([0, 1], 350)
    sig = near.dart_minhash(doc, np.concatenate([a, b]), np.concatenate([wa, wb]), 2)
    assert (sig != near._EMPTY).all()
    assert abs((sig[0] == sig[1]).mean() - 300 / (600 + 100 + 100)) < 0.13


def test_signature_does_not_depend_on_the_batch():
    e = np.arange(1, 2001, dtype=np.uint64) * np.uint64(7919)
    one = near.dart_minhash(np.zeros(2000, int), e, np.ones(2000, int), 1)
    two = near.dart_minhash(np.repeat([0, 1], [2000, 3]), np.concatenate([e, e[:3]]), np.ones(2003, int), 2)
    assert (one[0] == two[0]).all() and (two[1] != near._EMPTY).all()


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (3, "a b c d e f", 3), (4, None, 4), (None, "other words are here now too", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    assert near.classes(docs).count() == 5
    assert sorted(r["node"] for r in near.keep_one(docs).collect())[-2:] == [4, 5] and near.keep_one(docs).count() == 3
    none = docs.where("false")
    assert near.classes(none).count() == 0 and near.keep_one(none).columns == docs.columns


def test_names_of_scratch_columns_are_free(spark):
    text = " ".join(f"w{i}" for i in range(60))
    names = ["_n", "_node", "node", "row", "_d", "_th", "label"]
    rows = [(1, text, *range(7)), (2, text + " more", *range(7, 14)), (3, None, *range(14, 21)), (4, "other words", *range(21, 28))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = sorted(tuple(r) for r in near.keep_one(docs).collect())
    assert got == [rows[0], rows[2], rows[3]]
    assert near.keep_one(docs).columns == docs.columns


def test_sets_of_pairs_stay_inside_spark(spark, monkeypatch):
    r = random.Random(5)
    made = {i: sorted(r.sample(range(-30, 30), r.randint(20, 50))) for i in range(40)}
    node = lambda i: (i, -i)
    sets = spark.createDataFrame([(node(i), x) for i, x in made.items()], f"node {near.NODE}, set array<int>")
    pairs = spark.createDataFrame([(node(i), node(j)) for i in made for j in range(i)], f"a {near.NODE}, b {near.NODE}")
    plans, materialize = [], near.materialize
    monkeypatch.setattr(near, "materialize", lambda df: plans.append(df._jdf.queryExecution().toString()) or materialize(df))
    got = {(x["a"]["h1"], x["b"]["h1"]) for x in near.verified(sets, pairs, 0.5).collect()}
    similar = lambda a, b: len(a & b) >= 0.5 * len(a | b)
    assert got == {(i, j) for i in made for j in range(i) if similar(set(made[i]), set(made[j]))}
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
    assert len(got) > 10
