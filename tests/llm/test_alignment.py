"""Alignment against one made with the libraries alone, and the bitmaps against sets."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewatch.llm import alignment, bitmaps

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def letters():
    """The byte of each letter of byte-level BPE, as its tokenizer writes single bytes."""
    out, extra = {}, 0
    for x in range(256):
        plain = 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255
        out[chr(x) if plain else chr(256 + extra)] = x
        extra += not plain
    return out


def brute(texts):
    tok, sp, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), letters()
    tok.encode_special_tokens = True
    docs = []
    for t in texts:
        docs.append(None)
        if not t:
            continue
        raw = (" " + t).encode()
        a = tok.encode(" " + t, add_special_tokens=False)
        ab = [bytes(byte[c] for c in x) for x in a.tokens]
        b = sp.encode(t)
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if b"".join(ab) != raw or b"".join(bb) != raw:
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (ab, bb)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links, i, j = [], [], 0, 0
        for e in both:
            i2, j2 = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(",".join(map(str, a.ids[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links.append((a.ids[i2 - 1], b[j2 - 1]))
            i, j = i2, j2
        docs[-1] = (len(a.ids), len(b), groups, links)
    count = Counter(x for d in docs if d for x in d[3])
    have = Counter(x for d in docs if d for x in set(d[3]))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for i, d in enumerate(docs):
        if d is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, "", 0))
        else:
            rows.append((i, d[0], d[1], len(d[2]), len(d[3]), sum(count[x] == most[x[1]] for x in d[3]), sum(count[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest(), sum(have[x] for x in d[3])))
    return rows


def found(spark, texts):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, block int, pairs string")
    return sorted(tuple(r) for r in alignment.report(df.repartition(3), A, B).collect())


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "  a  b  ", "tab\there", "line\nbreak \n next\n\n  x", "déjà vu, naïve café", "日本語 テキスト", "a▁b", "▁", "😀 emoji 👩‍👩‍👧", "<|endoftext|> inside", "<unk> <s> </s>", "<0x41>",
    "don't we'll I'M", "1234567 89,000.5", "x y  z", "a\x00b", "\x1c \x1d\x1e", "trail \t", "é combined", "http://example.org/a?b=c&d=e", "A" * 3000, "the the the the", "the the", "\r\n \r\n", "ﬁ ligature ①", "   b", "fin　 de",
]


def test_odd_texts(spark):
    assert found(spark, ODD) == brute(ODD)


def test_sample_table_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_ENTRIES", 900)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()] + ["of of the", "of of the"]
    assert found(spark, texts) == brute(texts)


@pytest.mark.parametrize("texts", [[None, ""], []])
def test_nothing(spark, texts):
    assert found(spark, texts) == brute(texts)


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 9000, bitmaps.BLOCK):
        x = np.sort(rng.choice(bitmaps.BLOCK, n, replace=False))
        p = bitmaps.pack(x)
        assert bitmaps.positions(p).tolist() == x.tolist() and bitmaps.popcount(p) == n and len(p) <= bitmaps.BLOCK // 8
    one, two = rng.choice(bitmaps.BLOCK, 3000, replace=False), rng.choice(bitmaps.BLOCK, 10, replace=False)
    both = bitmaps.either([bitmaps.pack(np.sort(one)), bitmaps.pack(np.sort(two)), b""])
    assert set(bitmaps.positions(both).tolist()) == {*one.tolist(), *two.tolist()}


def test_counted_bitmaps_of_parts():
    rng = np.random.default_rng(2)
    want, parts = Counter(), {}
    for half in range(2):
        n = 6000
        key, at = rng.integers(0, 9, n) ** 2, rng.integers(0, 8000, n) * 2 + half
        own = Counter(zip(key.tolist(), at.tolist()))
        want += own
        rows = sorted(own)
        keys, planes = bitmaps.counted(np.array([k for k, _ in rows]), np.array([a for _, a in rows]), np.array([own[x] for x in rows]))
        for k, p in zip(keys.tolist(), planes.to_pylist()):
            parts.setdefault(k, []).append(p)
    got = Counter()
    for k, p in parts.items():
        planes = bitmaps.merge(p)
        assert bitmaps.total(planes) == sum(n for (x, _), n in want.items() if x == k)
        assert bitmaps.popcount(bitmaps.either(planes)) == sum(x == k for x, _ in want)
        for a, n in zip(*(x.tolist() for x in bitmaps.counts(planes))):
            got[k, a] += n
    assert got == want
