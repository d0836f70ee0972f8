"""The rolling hash tells apart what a polynomial modulo a power of two does not."""

import random

import numpy as np

from tidewatch.llm import quality
from tidewatch.llm.common import Rolling

MORSE = "".join("ab"[i.bit_count() & 1] for i in range(4096))
OTHER = MORSE.translate(str.maketrans("ab", "ba"))


def test_spans_agree_only_if_their_bytes_do():
    r = random.Random(1)
    data = bytes(r.choice(b"ab") for _ in range(3000)) + MORSE.encode() + OTHER.encode()
    roll = Rolling(np.frombuffer(data, np.uint8))
    for n in (1, 3, 9, 48, 200, 1024, 2048):
        s = np.arange(len(data) - n + 1)
        h = roll.spans(s, s + n)
        texts = {}
        for i, x in enumerate(h.tolist()):
            assert texts.setdefault(x, data[i : i + n]) == data[i : i + n]
        assert len(texts) == len({data[i : i + n] for i in s})


def test_complementary_lines_are_no_copies(spark):
    docs = spark.createDataFrame([(n, MORSE[:n] + "\n" + OTHER[:n]) for n in (1024, 2048, 4096)] + [(1, MORSE + "\n" + MORSE)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dup_lines"] for r in quality.judge(docs).collect()}
    assert got == {1024: 0, 2048: 0, 4096: 0, 1: 1}
