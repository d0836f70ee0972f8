import random

import pytest

from test_lines_similar import twins

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order_and_columns(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n))
    base = [text(8) for _ in range(40)]
    passage = " ".join(word() for _ in range(60)) + "."
    texts = [*base, base[0], base[1] + "\nOne more line of these words here.", base[2] + "\n" + passage, " ".join(word() for _ in range(40)) + " " + passage + " " + " ".join(word() for _ in range(40)) + ".", "### $$$ *** " * 60, "too short", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]
    kept = docs
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        ids.append({row["doc_id"]: row["text"] for row in kept.collect()})
    assert set(ids[0]) == set(range(44))
    assert ids[1][0] == base[0] and ids[1][40] == "" and ids[1][41] == "One more line of these words here."
    assert 40 in ids[2] and len(ids[2]) == 44
    assert passage not in ids[3][42] and passage not in ids[3][43] and ids[3][5] == base[5]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {row["doc_id"] for row in packed} == set(range(44))


def test_line_dedup_finds_lines_that_share_large_blocks_only(spark):
    made = twins()
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: x if i < 150 else "" for i, x in enumerate(made)}
