"""Readiness of learnt baselines, recent scores, accepted blocks and the detector end to end."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.config import Confirm
from tidewatch.functions import scalars as S
from tidewatch.operators import baseline, confirm, detect, reports, scorer, windows
from tidewatch.operators import indicators as ind
from tidewatch.operators.indicators import indicators

FULL = "seq long, ts long, source_ip string, source string, method string, path string, status int, user_agent string, referer string"
TICKS = "tick long, dim string, p50 double, p95 double, p99 double, n long"


def requests(spark, rows):
    """rows: (ts, ip, path, status, agent)."""
    return spark.createDataFrame([(i, ts, ip, "nginx_access", "GET", path, status, ua, "") for i, (ts, ip, path, status, ua) in enumerate(rows)], FULL)


def test_learnt_baseline_waits_for_samples_and_age(spark):
    ticks = spark.createDataFrame([(1000, "qps", 1.0, 2.0, 3.0, 60), (1000, "r4xx", 0.1, 0.2, 0.3, 30), (1020, "qps", 4.0, 5.0, 6.0, 70)], TICKS)
    ts = [999, 1005, 1019, 1020, 1299, 1300, 9000, None]
    e = spark.createDataFrame(list(enumerate(ts)), "seq long, ts long")
    got = [r["b"] for r in baseline.learnt(e, ticks, F.lit(1000), "b").orderBy("seq").collect()]
    assert [x["own_qps_p95"] for x in got] == [0, 2, 2, 5, 5, 5, 5, 0]
    assert [x["qps_p95"] for x in got] == [1000] * 5 + [5, 5, 1000]
    assert [x["r4xx_p95"] for x in got] == [1] * 5 + [0.2, 0.2, 1]
    assert [x["conf"] for x in got] == [0] * 5 + [0.5, 0.5, 0] and {x["own_conf"] for x in got} == {0.5}
    few = baseline.learnt(e, ticks.where("dim = 'r4xx'"), F.lit(1000), "b")
    assert few.where("b.conf > 0").count() == 0 and baseline.learnt(e, ticks.limit(0), F.lit(1000), "b").where("b.conf > 0").count() == 0


def test_learnt_baseline_keeps_events_with_like_named_columns(spark):
    e = spark.createDataFrame([(1, 5000, "x"), (2, 5001, "y")], "seq long, ts long, tick string")
    ticks = spark.createDataFrame([(1000, "qps", 1.0, 2.0, 3.0, 160)], TICKS)
    assert {r["tick"] for r in baseline.learnt(e, ticks, F.lit(1000), "b").where("b.conf = 0.5").collect()} == {"x", "y"}


def test_events_of_one_second_do_not_merge_when_merging_is_off():
    state, block = confirm.step(None, 1000, "/a", False, Confirm(2, 30, 0))
    assert not block and confirm.step(state, 1000, "/a", False, Confirm(2, 30, 0))[1]
    assert not confirm.step(state, 1000, "/a", False, Confirm(2, 30, 5))[1]


def test_accepted_blocks_clear_the_observation(spark):
    r = random.Random(7)
    rows, ts = [], 1000
    for i in range(900):
        ts += r.choice([0, 1, 3, 7, 40, 130])
        rows.append((f"ip{r.randint(1, 3)}", ts, i, r.choice(["/a", "/b"]), r.random() < 0.8, r.random() < 0.02, r.random() < 0.03))
    df = spark.createDataFrame(rows, "source_ip string, ts long, seq long, path string, is_high boolean, high_confidence boolean, honeypot boolean")
    c, ttl, want = Confirm(3, 20, 2), 100, {}
    for ip in ("ip1", "ip2", "ip3"):
        state, until = None, 0
        for _, t, seq, path, high, sure, trap in (x for x in rows if x[0] == ip and x[4]):
            block = trap
            if not trap:
                state, block = confirm.step(state, t, path, sure, c)
            if block:
                want[seq] = t >= until
                if t >= until:
                    until, state = t + ttl, state if trap else None
    assert {x["seq"]: x["accepted"] for x in confirm.confirm_blocks(df, c, ttl).collect()} == want
    assert set(want.values()) == {True, False}
    assert confirm.confirm_blocks(df, c).where("accepted").count() == 0


def test_moving_average_of_a_long_session(spark):
    rows = [(1000 + i // 7, "1.1.1.1", "/", 200, "") for i in range(3000)]
    got = {r["seq"]: r for r in windows.ema(requests(spark, rows)).select("seq", "seen", "ema").collect()}
    e = 0.0
    for i in range(3000):
        e = 0.95 * e + 0.05 * (i % 7 + 1) / 10
        assert got[i]["seen"] == i + 1 and abs(got[i]["ema"] - e) < 1e-12


def test_recent_score_counts_plainly_and_forgets_idle_addresses(spark):
    rows = [(1000 + i // 10, "1.1.1.1", "/.env", 404, "masscan/1.3") for i in range(40)] + [(500, "2.2.2.2", "/.env", 404, "masscan/1.3")]
    e = windows.ema(indicators(requests(spark, rows)))
    base = {"conf": F.lit(0.5)} | {f"{d}_{k}": F.lit(v) for d in baseline.DIMS for k, v in (("p50", 0.01), ("p95", 0.02), ("n", 100))}
    got = {r["source_ip"]: r["score"] for r in scorer.recent_scores(e, F.lit(1003), base).collect()}
    assert set(got) == {"1.1.1.1"} and got["1.1.1.1"] > 50
    assert {r["score"] for r in scorer.recent_scores(e, F.lit(1250), base).collect()} == {0}
    assert scorer.recent_scores(e.limit(0), F.lit(1003), base).count() == 0


def test_statistics_see_scores_from_low_on(spark):
    e = spark.createDataFrame([(0, "a", 9, False), (1, "a", 10, False), (2, "b", 50, True), (700, "c", 3, False)], "ts long, source_ip string, final long, is_high boolean")
    assert [r["final"] for r in reports.logged(e, 0).orderBy("ts").collect()] == [10, 50]
    got = [tuple(r) for r in reports.logged_report(e).orderBy("period").collect()]
    assert got == [(0, 3, 2, 2, 1, 1), (600, 1, 0, 0, 0, 0)]


@pytest.fixture(scope="module")
def traffic(spark):
    """Thirteen calm addresses (enough samples for a baseline), a scanner, one that enumerates, a trap, a skipped path, the host itself."""
    calm = [(1000 + i, f"7.7.7.{k}", f"/r/{i % 5}", 200, "Mozilla/5.0 Chrome/120.0 Safari/537.36") for i in range(330) for k in range(13)]
    scan = [(1315 + i // 20, "9.9.9.9", f"/p{i}/.env", 404, "masscan/1.3") for i in range(100)]
    ids = [(1200 + i // 2, "5.5.5.5", f"/o/{i}", 200, "Mozilla/5.0 Chrome/120.0 Safari/537.36") for i in range(30)]
    other = [(1318, "8.8.8.8", "/trap/x", 200, ""), (1319, "8.8.8.8", "/favicon.ico", 200, ""), (1320, "127.0.0.1", "/trap/x", 200, "")]
    return requests(spark, sorted(calm + scan + ids + other))


def test_detector_end_to_end(spark, traffic):
    cfg = config.DetectorConfig(honeypot_paths=("/trap/",))
    found = detect.detect(traffic, cfg, ("^/o/", "/o/([0-9]+)", 20)).cache()
    assert found.count() == 13 * 330 + 100 + 30 + 1
    assert [tuple(r) for r in found.where("honeypot").select("source_ip", "final").collect()] == [("8.8.8.8", 100)]
    assert {r[0] for r in found.where("is_high").select("source_ip").distinct().collect()} == {"8.8.8.8", "9.9.9.9"}
    raised = [r["final"] - r["best"] for r in found.where("source_ip = '5.5.5.5'").orderBy("seq").collect()]
    assert raised == [0] * 20 + [15] * 10
    blocks = detect.blocks(found, cfg).cache()
    assert sorted(r["source_ip"] for r in blocks.where("accepted").collect()) == ["8.8.8.8", "9.9.9.9"]
    assert blocks.where("not accepted").count() > 0
    assert detect.blocks(found, replace(cfg, report_only=True)).count() == 0


def test_detector_trusts_what_the_preload_gives(spark, traffic):
    cfg, doubted = config.DetectorConfig(honeypot_paths=("/trap/",)), baseline.Preload(10, 5, 0, 0.05, {})
    found = detect.detect(traffic, cfg, preload=doubted).where("is_high").select("source_ip").distinct().collect()
    assert [r[0] for r in found] == ["8.8.8.8"]


def test_detector_on_no_events(spark, traffic):
    assert detect.detect(traffic.limit(0)).count() == 0


def test_paths_and_agents_are_looked_up_once_a_value(spark, monkeypatch):
    paths, agents = ["/a", "/%2561dmin/x", "/trap//x", "/favicon.ico", "/q?x=<script>", "/i/77.png", None], ["Mozilla/5.0 Chrome/120.0 Safari/537.36", "sqlmap/1.7", "", None]
    e = requests(spark, [(1000 + i, "1.1.1.1", paths[i % 7], 404, agents[i % 4]) for i in range(56)]).localCheckpoint()
    cfg = config.DetectorConfig(honeypot_paths=("/trap/",))
    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(indicators(e, cfg).withColumn("route", ind.route(cfg, clean=True)))
    for few in (100, 0):
        monkeypatch.setattr(ind, "FEW_VALUES", few)
        rows = ind.looked_up(e, cfg)
        got = indicators(rows.withColumn("route", ind.route(cfg, known=True)), cfg)
        assert plain(got.select(*e.columns, *ind.COUNTERS, "route")) == want
        assert ("ArrowEvalPython" in rows._jdf.queryExecution().optimizedPlan().toString()) == (few == 0)
    assert {r[0] for r in rows.where("path like '/i/%'").select("_base").collect()} == {r[0] for r in e.where("path like '/i/%'").select(S.normalize_404_path(F.col("path"))).collect()}


def test_snapshots_over_panes_are_those_over_events(spark):
    r = random.Random(3)
    e = indicators(requests(spark, [(1000 + r.randrange(200), f"1.1.1.{r.randrange(3)}", "/a", r.choice([200, 404]), "") for _ in range(300)]))
    for w in (10, 30, 60):
        assert set(windows.snapshots(windows.panes(e), w).collect()) == set(windows.snapshots(e, w).collect())


def test_baselines_of_several_windows_join_the_events_once(spark):
    ticks = [spark.createDataFrame([(1000, "qps", 1.0 + k, 2.0 + k, 3.0, 160), (1020, "r4xx", 0.1, 0.2 + k, 0.3, 30)], TICKS) for k in range(3)]
    e = spark.createDataFrame(list(enumerate([999, 1005, 1300, 9000, None])), "seq long, ts long")
    want = e
    for k in range(3):
        want = baseline.learnt(want, ticks[k], F.lit(1000), f"b{k}")
    got = baseline.all_learnt(e, {f"b{k}": t for k, t in enumerate(ticks)}, F.lit(1000), times=e)
    assert got.columns == want.columns and got.orderBy("seq").collect() == want.orderBy("seq").collect()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
