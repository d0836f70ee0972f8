"""Settings that change between the micro-batches of a stream, and the report's dimensions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.operators import reports
from tidewatch.streaming.settings import Settings


def test_configurations_come_back_as_written():
    c = config.merge(config.DetectorConfig(), {"high": 70, "patterns": ["; rm "], "weights": {"pattern": 9}, "confirm": {"count": 4}})
    assert config.loads(config.dumps(c)) == c


def test_a_batch_keeps_its_settings_and_bad_ones_change_nothing(spark, tmp_path):
    s = Settings(spark, f"{tmp_path}/s")
    assert s.of(0) == config.DetectorConfig()
    assert s.offer({"high": 80, "sensitive_paths": {"items": ["vault"], "builtin": False}}) == 1
    for bad in ("{", "[1]", '{"high": "much"}', '{"high": 5}', '{"unheard": 1}', '{"bot_agents": [3]}', "null"):
        s.offer(bad)
    second = s.of(1)
    assert (second.high, second.sensitive_paths, second.patterns) == (80, ("vault",), config.DetectorConfig().patterns)
    assert sorted(s.refused) == [2, 3, 4, 5, 6, 7, 8]
    s.offer({"medium": 20})
    # What has run already runs the same again, from a new process too.
    assert Settings(spark, f"{tmp_path}/s").of(0) == config.DetectorConfig() and s.of(1) == second
    assert (s.of(2).medium, s.of(2).high) == (20, 50)


def test_fetched_lists_come_in_by_version(spark, tmp_path):
    offers = [(1, ["/old", " /old "]), (1, ["/ignored"]), (2, ["/new", ""])]

    def provider(session):
        version, values = offers[0]
        return version, session.createDataFrame([("path", v, i) for i, v in enumerate(values)], "category string, value string, ord long")

    s = Settings(spark, f"{tmp_path}/s", provider)
    s.offer({"sensitive_paths": {"items": ["/mine"], "excludes": ["env"]}, "patterns": {"cloud": False}})
    seen = []
    while offers:
        seen.append(set(s.current().sensitive_paths) - set(config.DetectorConfig().sensitive_paths))
        assert "env" not in s.current().sensitive_paths and "select " in s.current().patterns
        offers.pop(0)
    assert seen == [{"/mine", "/old"}, {"/mine", "/old"}, {"/mine", "/new"}]


def test_a_stream_changes_lists_between_batches(spark, tmp_path):
    s, got = Settings(spark, f"{tmp_path}/s"), {}
    work = s.each(lambda batch, cfg, k: got.setdefault(k, (cfg.high, batch.count())))
    for k, change in enumerate([{"high": 60}, {"high": 1}, {"high": 90}]):
        spark.range(k + 1).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("id long").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        assert stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(work).trigger(availableNow=True).start().awaitTermination(60)
        s.offer(change)
    assert got == {0: (50, 1), 1: (60, 2), 2: (60, 3)}
    assert s.current().high == 90


def test_sketch_keeps_its_error(spark):
    r = random.Random(4)
    values = [f"/{int(r.paretovariate(0.9))}" for _ in range(30_000)]
    rows = [(i % 3000, v, "a", "GET", 200) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "ts long, path string, user_agent string, method string, status int").repartition(4)
    tracked = 256
    got = reports.sketched_stats(reports.feature_sketches(df, 600, tracked), 50, tracked).where("dim = 'path'").collect()
    true, off = Counter(values), 3.5 / tracked * len(values)
    assert len(true) > tracked
    assert all(abs(x["hits"] - true[x["value"]]) <= off for x in got)
    assert {v for v, n in true.items() if n > off} <= {x["value"] for x in got}


def test_dimension_hits(spark):
    r = random.Random(5)
    parts = list(reports.HITS.values())
    rows = [(i * 7, r.choice(["nginx_access", "linux_auth", "other", None]), r.choice([None, 0, 9, 10, 40]), *[r.choice([0, 0, 3]) for _ in range(2 * len(parts))]) for i in range(300)]
    names = [f"{p}_{w}" for p in parts for w in (10, 30)]
    df = spark.createDataFrame(rows, "ts long, source string, final long, " + ", ".join(f"{n} long" for n in names))
    got = {x["period"]: x.asDict() for x in reports.dimension_hits(df, (10, 30)).collect()}
    want = {}
    for ts, source, final, *points in rows:
        if (final or 0) >= 10:
            one = want.setdefault(ts // 600 * 600, Counter())
            one["total"] += 1
            one["from_nginx"] += source == "nginx_access"
            one["from_linux"] += source == "linux_auth"
            for k, n in enumerate(reports.HITS):
                one[f"{n}_hits"] += max(points[2 * k : 2 * k + 2]) > 0
    assert got.keys() == want.keys()
    assert all(got[p][n] == x[n] for p, x in want.items() for n in ["total", "from_nginx", "from_linux", *(f"{n}_hits" for n in reports.HITS)])
    assert reports.dimension_hits(df.where(F.lit(False)), (10, 30)).count() == 0
