import hashlib
import zlib

import numpy as np
import pytest

from tidewatch.llm import binary, media, packing, pieces, quality, sharding

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [
    "", None, " ", "  a", "a  b ", "▁x ▁", "a　b", "ﬁ é", "don't I'LL we've", "a\n b\n\n c \n", " <|endoftext|> x", "\x1cfoo\x85 bar\xa0baz", "É̃ ́ x", "x\t\ty  \t z",
    "中文 字 😀😀", "ſ ǅ İ", "a <s> </s> <unk>", "12345 ½", "The Quick brown fox. " * 900, "Größe naïve café " * 40,
]


def table(spark, texts, extra=True):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = table(spark, ODD)
    got = {r["doc_id"]: r for r in pieces.digest(docs, model).collect()}
    ids = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, model).collect()}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    for i, t in enumerate(ODD):
        want = sp.encode(t or "")
        assert ids[i] == want and got[i]["n_tokens"] == len(want) and back[i] == sp.decode(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(sp.decode(want).encode()).hexdigest()
    assert pieces.digest(docs.where("false"), model).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    r = np.random.default_rng(1)
    for n in (0, 1, binary.BLOCK, 3 * binary.BLOCK + 7):
        ids = r.integers(0, 2**32, n, dtype=np.uint32)
        planes = binary.shuffle_planes(ids, kind)
        assert len(planes) == (4 if kind == "byte" else 32)
        assert (binary.unshuffle_planes(planes, n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_binary_files_equal_the_library(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(binary, "CHUNK_IDS", 3000)
    encode = library("byte_bpe_50k.json")
    texts = [*ODD, *ODD]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[-3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"{tmp_path}/{kind}"
    binary.write(docs, public_tokenizers.path("byte_bpe_50k.json"), path, kind=kind)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in binary.check(spark, path).collect()))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc, t in order:
        ids = encode(t) + [0]
        want.append((start, doc, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    full = {r["start"]: r["ids"] for r in binary.read(spark, path).collect()}
    assert [full[s] for s, *_ in want] == [encode(t) + [0] for _, t in order]


def test_empty_binary_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert binary.write_and_check(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_is_gapless_and_complete(spark):
    encode = library("word_bpe_49k.json")
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, *[f"word{i} " * (i * 7) for i in range(120)]]
    got = packing.pack_documents(table(spark, texts), path).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = encode(t) + [1]
        want |= {(i, k // 4096): (k, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for k in range(0, len(ids), 4096)}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for slots in by.values():
        at = 0
        for o, n in sorted(slots):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.pack_documents(table(spark, texts).where("false"), path).count() == 0


def test_plan_is_best_fit_decreasing():
    import random

    for seed in range(20):
        r = random.Random(seed)
        cap = r.choice([10, 64, 100])
        lengths = [r.randint(1, cap) for _ in range(r.randint(1, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        bins, rooms = {}, []
        for length, a, b, each, first, offset in packing.plan(counts, cap):
            for k in range(b - a):
                bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
        for n in sorted(lengths, reverse=True):
            fit = [x for x in rooms if x >= n]
            room = min(fit) if fit else cap
            if fit:
                rooms.remove(room)
            rooms.append(room - n)
        assert len(bins) == len(rooms)
        assert sorted(n for b in bins.values() for _, n in b) == sorted(lengths)
        for b in bins.values():
            assert all(o == sum(n for p, n in b if p < o) for o, _ in b) and sum(n for _, n in b) <= cap


def test_shards_are_even_and_gapless(spark):
    import random

    r = random.Random(2)
    texts = ["x" * r.randint(0, 3000) for _ in range(600)] + ["hot text " * 50] * 400 + ["", None, "é"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 30 + [(None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.assign(docs, 8).collect()
    assert len(got) == len(rows)
    load, slots = [0] * 8, {}
    for x in got:
        load[x["shard"]] += x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert max(load) - min(load) <= 0.03 * sum(load) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((x["size"], x["text_crc32"]) for x in got) == want
    assert sharding.assign(docs.where("false"), 8).count() == 0


def test_media_round_trip(spark):
    import random

    r = random.Random(3)
    base = "".join(r.choice("abcdefgh \n") for _ in range(40_000))
    texts = ["", None, "é" * 10, "x" * 64, base, base[:20_000] + "INSERT" + base[20_000:], base, base[5000:], "short", "short", "z" * 50_000]
    docs = table(spark, texts)
    rows, shared = media.store(docs)
    assert 0 < shared.count() < rows.selectExpr("explode(chunks)").count()
    got = {x["doc_id"]: x for x in media.read(rows, shared).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        wav = media.wave(p)
        x = got[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (x["media_bytes"], x["media_sha256"], x["feature"]) == (len(wav), hashlib.sha256(wav).hexdigest(), media.feature(p))
    assert media.store_and_describe(docs.where("false")).count() == 0


def test_cuts_move_only_near_an_insertion():
    r = np.random.default_rng(4)
    data = r.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    a, b = media.cut(data), media.cut(data[:100_000] + b"!" + data[100_000:])
    assert b"".join(a) == data and len(set(a) & set(b)) >= len(a) - 3
    assert all(len(c) <= media.MOST for c in a)


def counted(text):
    import re
    from collections import Counter

    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    three, cover, seen, same = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for i in range(len(w) - 2):
        if three[w[i], w[i + 1], w[i + 2]] > 1:
            cover |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            same += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), same, len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_quality_counts_and_verdicts(spark):
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 9)))
    prose = ["\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(r.randint(6, 12))) for _ in range(60)]
    junk = [" ".join(word() + r.choice(["***", "$$$", "###"]) for _ in range(90)) for _ in range(6)] + [" ".join(word().upper() + "!!" for _ in range(90)) for _ in range(6)] + [" | ".join(word() for _ in range(90)) for _ in range(6)]
    odd = ["", None, " \n\t\n", "same line here\n" * 30, "a b c " * 40, "é " * 60, "x\x0by\x0cz\r\n" * 25]
    texts = [*prose, *junk, *odd, *ODD]
    docs = table(spark, texts)
    got = {x["doc_id"]: x for x in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == counted(t), repr(t)[:80]
        assert not (x["kept"] and x["base_failed"])
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 78))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {i for i, x in got.items() if x["kept"]}
    assert quality.judge(docs.where("false")).count() == 0
