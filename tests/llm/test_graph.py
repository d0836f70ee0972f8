import random

from pyspark.sql import functions as F

from tidewatch.llm import graph
from tidewatch.llm.graph import components, extended, open_pairs, tiled_pairs


def test_components_match_union_find(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = [(i, i + 1) for i in range(100, 130)] + [(200, k) for k in range(201, 240)] + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)]
        r.shuffle(edges)
        up = {}

        def root(i):
            while up.setdefault(i, i) != i:
                i = up[i]
            return i

        for a, b in edges:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        got = {x["node"]: x["label"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {n: root(n) for e in edges for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_extended_labels_are_those_of_all_edges(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(240)]
    edges = [(a, b) for a, b in edges if a != b]
    of = lambda e: spark.createDataFrame(e, "a long, b long")
    want = {(x["node"], x["label"]) for x in components(of(edges)).collect()}
    for k in (1, 100, len(edges) - 1):
        got = [(x["node"], x["label"]) for x in extended(components(of(edges[:k])), of(edges[k:])).collect()]
        assert set(got) == want and len(got) == len(want)


def test_tiles_hold_all_open_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE", 8)
    r = random.Random(10)
    rows = [(b, n, n if r.random() < 0.7 else r.randrange(5), r.randint(20, 60)) for b, size in ((1, 70), (2, 40), (3, 5)) for n in r.sample(range(1000), size)]
    left = spark.createDataFrame(rows, "bucket long, node long, label long, len int")
    left = left.join(left.groupBy("bucket").agg(F.count("*").alias("k")), "bucket").withColumn("part", F.floor(F.col("len") / 5)).localCheckpoint()
    near = F.abs(F.col("l.len") - F.col("r.len")) <= 5
    want, got = open_pairs(left, near).collect(), tiled_pairs(left, near).collect()
    assert len(got) == len(set(got)) > 500 and set(got) == set(want)
