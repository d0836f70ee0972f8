import hashlib
import random
from collections import Counter

import pytest

from tidewatch.llm import suffix


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    pool = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(8)]
    texts = ["", None, "a" * 300, "ab" * 200, pool[0] * 4]
    for _ in range(n):
        parts = [r.choice(pool) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 5))]
        t = " ".join(parts)
        if r.random() < 0.3 and t:
            k = r.randrange(len(t))
            t = t[:k] + "X" + t[k + 1 :]
        texts.append(t)
    return texts + texts[-3:]


@pytest.mark.parametrize(("seed", "window", "group"), [(1, 40, 20_000), (2, 25, 20_000), (3, 60, 3)])
def test_matches_brute_force(spark, seed, window, group, monkeypatch):
    monkeypatch.setattr(suffix.repeated, "__defaults__", (window, group))
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.digest(docs, window).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_buckets_hold_whole_hashes_that_the_quicksort_parts():
    r = random.Random(9)
    gram = {kh: bytes(r.choice(b"abcdefgh") for _ in range(48)) for kh in range(50)}
    rows = [(kh, ch, gram[kh] + b"%d" % ch) for kh in range(50) for ch in range(r.randint(1, 5)) for _ in range(r.randint(1, 2))]
    made = list(suffix.buckets(rows, 20))
    assert [x for b in made for x in b] == sorted(set(rows))
    for bucket in made:
        hashes = {x[0] for x in bucket}
        assert not any(hashes & {x[0] for x in b} for b in made if b is not bucket)
        groups = suffix.multikey_quicksort([x[2] for x in bucket], 48)
        assert len(groups) == len(hashes) and all(len({bucket[i][0] for i in g}) == 1 for g in groups)
        assert [gram[bucket[g[0]][0]] for g in groups] == sorted(gram[k] for k in hashes)
    assert len(made) > 3 and max(len({x[0] for x in b}) for b in made) > 2 and not list(suffix.buckets([]))


def test_window_200_long_text_and_repeated_rows(spark):
    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(5000))
    texts = [base, base[1000:1300] + "zz", base[:150], base[2000:2199], "x" + base[3000:3200] + "y"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, base[:150], "s"), (4, texts[4], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cuts string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *tuple(r)[1:]) for r in suffix.digest(docs).collect())
    want = sorted((r[0] if r[0] is not None else -1, *b) for r, b in zip(rows, brute([r[1] for r in rows], 200)))
    assert got == want


def test_remove_keeps_columns_and_characters(spark):
    t = "é" * 200
    docs = spark.createDataFrame([(1, "x" + t, 7, 1, 2, 3), (2, t + "yz", 8, 4, 5, 6), (3, None, 9, 7, 8, 9)], "doc_id long, text string, _cuts int, _th int, cuts int, row int")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.remove(docs).collect()}
    assert got == {1: ("x", 7, 1, 2, 3), 2: ("yz", 8, 4, 5, 6), 3: (None, 9, 7, 8, 9)}
    assert suffix.remove(docs).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.digest(docs).count() == 0 and suffix.remove(docs).count() == 0


def test_sorting_gives_suffix_order():
    r = random.Random(3)
    items = ["".join(r.choice("ab") for _ in range(r.randint(0, 120))).encode() for _ in range(300)] + [b"a" * 100] * 3
    order = []
    for group in suffix.multikey_quicksort(items, 64):
        trie = suffix.BlindTrie(items)
        for i in group:
            trie.add(i)
        order += [i for _, _, leaf in trie.walk() if leaf for i in leaf]
    assert [items[i] for i in order] == sorted(items)
