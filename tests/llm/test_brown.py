import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tidewatch.llm import brown

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low) + [None]


def corpus(seed=1, n=120):
    r = random.Random(seed)
    nouns, verbs, marks = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)], ["The", "a", "É", " x"]
    texts = ["", None, " \t\n", "ONE one"]
    for _ in range(n):
        texts.append(" ".join(x for _ in range(r.randint(3, 30)) for x in (r.choice(marks), r.choice(nouns), r.choice(verbs))) + f" rare{r.randint(0, 200)}")
    return texts


def base(texts):
    out = [(zlib.crc32(str(i).encode()) % 7 == 2) for i in range(len(texts))]
    c = Counter(t for text, h in zip(texts, out) if not h for t in tokens(text))
    total, types = sum(c.values()), len(c)
    return [(h, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), total, sum(math.log10((c[x] + 1) / (total + types + 1)) for x in tokens(t))) for t, h in zip(texts, out)]


def test_base_columns_and_held_out_gain(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for options in ({"exchanged": 64, "classes": 6}, {"exchanged": 20, "classes": 4, "lookup": 40}):
        got = {r["doc_id"]: r for r in brown.train_and_score(docs, **options).collect()}
        for i, (h, n, k, total, b) in enumerate(base(texts)):
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, k, total)
            assert abs(r["base_score"] - b) < 1e-6
        held = [r for r in got.values() if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_table_and_join_agree(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(2))), "doc_id long, text string")
    a = {r["doc_id"]: r["score"] for r in brown.train_and_score(docs, exchanged=10, classes=3).collect()}
    b = {r["doc_id"]: r["score"] for r in brown.train_and_score(docs, exchanged=10, classes=3, lookup=30).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6


def hashed(word):
    import pyarrow as pa

    return int(brown._tokens(pa.array([word]))[1][0])


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(3))), "doc_id long, text string")
    for lookup in (1 << 20, 40):
        m, _, known, _ = brown.train(docs, exchanged=20, classes=4, lookup=lookup)
        assert np.allclose((10**m.log_step).sum(1), 1)
        rows = known.toPandas()
        c = rows["c"].to_numpy()
        sums = np.bincount(c, weights=10 ** m.emission(c, rows["n"].to_numpy()))
        assert np.allclose(sums[sums > 0], 1) and (sums > 0).sum() >= 4
        assert len(rows) + 1 == m.words.types and not (c == 4).any()


def test_scores_by_brute_force(spark):
    """From the class of every word alone, transitions and scores are counted anew; both ways of looking words up."""
    texts = [*corpus(5), "n1 never seen words n2", "rare1 rare1", "never never"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for options in ({"exchanged": 20, "classes": 4}, {"exchanged": 20, "classes": 4, "lookup": 40}, {"exchanged": 5000, "classes": 7}):
        m, rows, known, late = brown.train(docs, **options)
        assert (late is None) == (options.get("lookup") is None)
        got = {r["doc_id"]: r for r in brown.score(m, rows, late).collect()}
        of = {r["w"] % 2**64: (r["c"], r["n"]) for r in known.collect()}
        wide = len(m.log_class)
        info = lambda x: (wide - 3, None) if x is None else of.get(hashed(x), (wide - 1, 0))
        t = np.zeros((wide, wide))
        for i, text in enumerate(texts):
            if zlib.crc32(str(i).encode()) % 7 != 2:
                seq = [info(None), *map(info, tokens(text))]
                for (ca, na), (cb, nb) in zip(seq, seq[1:]):
                    for x in [ca] + [wide - 1] * (na == 1):
                        for y in [cb] + [wide - 1] * (nb == 1):
                            t[x, y] += 1
        share = (t.sum(0) + 1) / (t.sum() + wide)
        step = np.log10((t + share) / (t.sum(1, keepdims=True) + 1))
        size = Counter()
        for c, n in of.values():
            size[c] += n
        for i, text in enumerate(texts):
            seq = [info(None), *map(info, tokens(text))]
            want = sum(step[a[0], b[0]] + (math.log10(b[1] / size[b[0]]) if b[1] else 0) for a, b in zip(seq, seq[1:]))
            assert abs(got[i]["score"] - want) < 1e-6, (i, options)
            assert math.isclose(got[i]["perplexity"], 10 ** (-want / len(seq[1:])))


def test_words_outside_the_exchange_go_to_the_class_of_their_neighbours(spark):
    """Nouns and verbs of equal neighbours: those that are placed join the classes of those that are exchanged."""
    r = random.Random(6)
    texts = [" ".join(x for _ in range(20) for x in ("the", f"n{int(40 * r.random() ** 2)}", f"v{int(40 * r.random() ** 2)}")) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for lookup in (1 << 20, 50):
        _, _, known, _ = brown.train(docs, exchanged=30, classes=3, lookup=lookup)
        of = {row["w"] % 2**64: row["c"] for row in known.collect()}
        nouns, verbs = Counter(of[hashed(f"n{i}")] for i in range(40)), Counter(of[hashed(f"v{i}")] for i in range(40))
        assert nouns.most_common(1)[0][1] >= 36 and verbs.most_common(1)[0][1] >= 36
        assert nouns.most_common(1)[0][0] != verbs.most_common(1)[0][0]


def test_repeated_rows_null_ids_long_text_and_other_columns(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, "a b", 1), (1, "a b", 2), (None, "a c", 3), (2, long, 4), (3, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid long")
    got = brown.train_and_score(docs, exchanged=10, classes=2, lookup=100).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 3, 3, 3, 60_001]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_gain_is_the_difference_of_objectives():
    r = np.random.default_rng(1)
    k, classes = 12, 3
    n = r.integers(0, 9, (k + 2, k + 2)).astype(float)
    cls = np.concatenate([np.arange(k) % classes, [classes, classes + 1]])

    def table(cls):
        t = np.zeros((classes + 2, classes + 2))
        np.add.at(t, (cls[:, None], cls[None, :]), n)
        return t

    t = table(cls)
    for w in range(k):
        left = np.bincount(cls, weights=n[:, w], minlength=classes + 2)
        right = np.bincount(cls, weights=n[w], minlength=classes + 2)
        gain = brown.gains(left, right, n[w, w], int(cls[w]), t, classes)
        for c in range(classes):
            other = cls.copy()
            other[w] = c
            assert abs(gain[c] - (brown.objective(table(other)) - brown.objective(t))) < 1e-6


def test_no_training_rows_and_empty_table(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = brown.train_and_score(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).collect()
    assert got[0]["base_score"] == 0 and got[0]["train_tokens"] == 0 and math.isfinite(got[0]["score"])
    assert brown.train_and_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
