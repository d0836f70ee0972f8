"""Two layers of threat scores against a model that goes row by row."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import layers

FEED = "layer string, whole boolean, seq long, ip string, score double, vote_count int, source string"


def feed_rows(seed):
    r = random.Random(seed)
    rows = []
    for layer in ("global", "tenant"):
        rows += [(layer, True, 50, f"10.0.0.{i}", float(r.randint(0, 100)), r.randint(0, 30), "global") for i in range(6)]
        rows += [(layer, False, s, f"10.0.0.{r.randint(0, 9)}", float(r.randint(0, 100)), r.randint(0, 30), "global") for s in range(1, 90)]
    return rows


@pytest.mark.parametrize("base, whole, shared, own", [("b2", False, 70, 60), ("b1", False, 70, 95), ("b1", True, 0, 0), ("b2", True, 99, 0), ("b2", False, 99, 99)])
def test_scores_and_cursor(spark, base, whole, shared, own):
    rows, at, server = feed_rows(1), layers.Cursor(base, shared, own), layers.Server("b2", whole)
    state, top = {}, {"global": shared, "tenant": own}
    for layer, need, since in (("global", base != "b2", shared), ("tenant", whole, own)):
        mine = [x for x in rows if x[0] == layer]
        start = [x for x in mine if x[1]] if need else []
        steps = sorted((x for x in mine if not x[1] and x[2] > (50 if need else since)), key=lambda x: x[2])
        for x in start + steps:
            state[x[3]] = (layer, x[4], x[5])
            top[layer] = max(top[layer], x[2])
    feed = spark.createDataFrame(rows, FEED)
    assert {x["ip"]: (x["layer"], x["score"], x["vote_count"]) for x in layers.scores(feed, at, server).collect()} == state
    assert tuple(layers.moved(feed, at, server).first()) == ("b2", top["global"], top["tenant"])


def test_allow_list_passes_the_decision(spark):
    feed = spark.createDataFrame([("global", False, 1, ip, 95.0, 25, "global") for ip in ("10.0.0.1", "10.0.1.1", "10.0.0.9")] + [("tenant", False, 2, "10.0.0.9", 0.0, 0, "")], FEED)
    white = spark.createDataFrame([(1, "10.0.1.0/24", "add"), (2, "7.7.7.7", "add"), (3, "7.7.7.7", "del"), (0, "10.0.0.1", "add")], "seq long, ip string, op string")
    local = spark.createDataFrame([], "ip string, freq double, detector double, last_seen long")
    got = {(x["ip"], x["layer"]): x["action"] for x in layers.applied(feed, white, local, F.lit(0), layers.Cursor("b", 0, 0), layers.Server("b")).collect()}
    assert got == {("10.0.0.1", "global"): "block", ("10.0.1.1", "global"): "filtered", ("10.0.0.9", "tenant"): "ignore", ("10.0.1.0/24", "tenant"): "white_add", ("7.7.7.7", "tenant"): "white_del"}


def test_empty_feed(spark):
    feed = spark.createDataFrame([], FEED)
    assert layers.scores(feed, layers.Cursor(), layers.Server("b")).count() == 0
    assert tuple(layers.moved(feed, layers.Cursor("a", 3, 4), layers.Server("b")).first()) == ("b", 3, 4)
