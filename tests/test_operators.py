import random

import pytest
from pyspark.sql import functions as F

from tidewatch import config, features
from tidewatch.config import Confirm
from tidewatch.operators import baseline, confirm, consistency, decision, scorer, windows
from tidewatch.operators.indicators import COUNTERS, indicators, route
from tidewatch.sources import access as src


# Windows


def events(spark, rows):
    """rows: (ts, ip, path, status, ua)."""
    full = [(i, ts, ip, "nginx_access", "GET", path, status, ua, "") for i, (ts, ip, path, status, ua) in enumerate(rows)]
    return spark.createDataFrame(full, "seq long, ts long, source_ip string, source string, method string, path string, status int, user_agent string, referer string")


def some_events(seed, n=400):
    r = random.Random(seed)
    ts, out = 3500, []
    for _ in range(n):
        ts += r.choice([0, 0, 1, 1, 2, 5, 70] if r.random() < 0.95 else [400])
        out.append((ts, f"9.9.9.{r.randint(1, 3)}", r.choice(["/a/1", "/a/12345", "/b", "/.env", "/c/d/e/f/g"]), r.choice([200, 404, 403, 499, 500]), "curl/8"))
    return out


def test_trailing_counters_and_distinct_bases_across_chunks(spark):
    rows = some_events(1)
    got = {r["seq"]: r for r in windows.window_counters(indicators(events(spark, rows))).collect()}
    base = {"/a/1": "/a/1", "/a/12345": "/a/{id}", "/b": "/b", "/.env": "/.env", "/c/d/e/f/g": "/c/d/e/f"}
    assert len(got) == len(rows)
    for i, (ts, ip, _, _, _) in enumerate(rows):
        for w in (10, 30, 60):
            past = [r for r in rows[: i + 1] if r[1] == ip and r[0] > ts - w]
            n404, n4xx = [r for r in past if r[3] == 404], [r for r in past if r[3] == 403]
            assert got[i][f"total_{w}"] == len(past)
            assert got[i][f"c404_{w}"] == min(len(n404), len({base[r[2]] for r in n404}))
            assert got[i][f"d4xx_{w}"] == len({base[r[2]] for r in n4xx})


def test_sessions_and_ema(spark):
    rows = some_events(2, 120)
    got = {r["seq"]: r for r in windows.ema(events(spark, rows)).collect()}
    state = {}
    for i, (ts, ip, *_) in enumerate(rows):
        s = state.get(ip)
        if s is None or ts - s["ts"] >= 300:
            s = {"ema": 0.0, "seen": 0, "ts": ts, "n": 0}
        s["n"] = s["n"] + 1 if s["ts"] == ts else 1
        s.update(ts=ts, seen=s["seen"] + 1, ema=0.95 * s["ema"] + 0.05 * s["n"] / 10)
        state[ip] = s
        assert got[i]["seen"] == s["seen"] and abs(got[i]["ema"] - s["ema"]) < 1e-12


def test_port_scan_limits(spark):
    rows = [("a", p, 100) for p in range(6)] + [("b", p, 100 + p) for p in range(16)] + [("c", 80, 100 + k % 3) for k in range(100)] + [("d", p, 100) for p in range(5)]
    ports = spark.createDataFrame([(i, ip, p, ts) for i, (ip, p, ts) in enumerate(rows)], "seq long, src_ip string, dst_port int, ts long")
    got = {r["src_ip"]: r for r in windows.port_scans(ports).collect()}
    assert set(got) == {"a", "b"} and got["a"]["seq"] == 5 and got["b"]["dst_port"] == 15 and got["a"]["score"] == 30


# Baseline


def test_baseline_fold_matches_a_model(spark):
    r = random.Random(5)
    start = 1000
    rows = []
    for k in range(260):
        for dim in ("qps", "r4xx"):
            p50 = r.random() * (3 if dim == "qps" else 0.01)
            rows.append((start + 10 * (k + 1), dim, p50, p50 * 2, p50 * 3, r.randint(1, 50)))
    ticks = spark.createDataFrame(rows, "tick long, dim string, p50 double, p95 double, p99 double, n long")
    got = {(x["tick"], x["dim"]): x for x in baseline.baselines(ticks, F.lit(start)).collect()}
    least = lambda p95, n: 1.0 if n == 0 or p95 <= 0 else min(50.0, max(0.5, p95 * 0.1))
    state = {}
    for tick, dim, p50, p95, p99, n in rows:
        d = 0.5 if tick - start < 1800 else 0.8
        old = state.get(dim)
        if dim == "qps":
            low = least(*((old[1], old[3]) if old else (1.0, 1)))
            new = (max(p50, low * 0.3), low, max(p99, low * 2), n) if p95 < low else (p50, p95, p99, n)
            if old:
                new = tuple(o * d + v * (1 - d) for o, v in zip(old[:3], new[:3])) + (n,)
                new = (new[0], max(new[1], least(new[1], n)), new[2], n)
        else:
            fl = lambda p: (max(p[0], 0.0003), max(p[1], 0.001), max(p[2], 0.003), p[3])
            new = fl((p50, p95, p99, n))
            if old:
                new = fl(tuple(o * d + v * (1 - d) for o, v in zip(old[:3], new[:3])) + (n,))
        state[dim] = new
        x = got[tick, dim]
        assert all(abs(a - b) < 1e-9 for a, b in zip((x["p50"], x["p95"], x["p99"]), new)) and x["n"] == n


def test_percentile_index_is_not_interpolated(spark):
    h = baseline.histogram(spark.range(100).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("value")), ["k"])
    r = baseline.percentiles(h, ["k"]).first()
    assert (r["p50"], r["p95"], r["p99"], r["n"]) == (50, 95, 99, 100)


@pytest.mark.parametrize(("u", "t1", "t3", "want"), [(0, 0, 0, False), (1, 1, 1, True), (3, 0.4, 1, True), (4, 0.5, 0.9, False), (10, 0.9, 0.95, True), (10, 0.5, 0.98, True), (10, 0.89, 0.97, False), (11, 0.99, 1.0, False)])
def test_proxy_boundaries(spark, u, t1, t3, want):
    row = spark.createDataFrame([(u, float(t1), float(t3))], "u int, a double, b double").select(baseline.proxy_suspected(F.col("u"), F.col("a"), F.col("b"))).first()
    assert row[0] is want


# Scores


MEDIUM = {"qps": (80, 100, 100), "r4xx": (0.02, 0.05, 100), "r5xx": (0, 0.02, 100), "r404": (0.01, 0.03, 100), "auth": (0, 0.01, 100), "sens": (0, 0.01, 100), "bot": (0, 0.02, 100), "empty_ref": (0.1, 0.3, 100), "head": (0, 0, 0)}


def medium(conf=0.5, w=60):
    out = {"conf": F.lit(conf)}
    for d, (a, b, n) in MEDIUM.items():
        k = w if d == "qps" else 1
        out |= {f"{d}_p50": F.lit(float(a) / k), f"{d}_p95": F.lit(float(b) / k), f"{d}_n": F.lit(n)}
    return out


def scored(spark, rows):
    return scorer.score(windows.ema(windows.window_counters(indicators(events(spark, rows)))), medium())


def test_scanner_scores_high_and_browser_does_not(spark):
    scan = [(1000 + i // 10, "1.1.1.1", f"/p{i}/.env", 404, "masscan/1.3") for i in range(40)]
    last = scored(spark, scan).orderBy(F.desc("seq")).first()
    assert last["final"] == 50 and last["is_high"]
    calm = events(spark, [(1000 + i, "2.2.2.2", f"/api/{i % 5}", 404, "Mozilla/5.0 Chrome/120.0 Safari/537.36") for i in range(30)]).withColumn("referer", F.lit("https://x/"))
    out = scorer.score(windows.ema(windows.window_counters(indicators(calm))), medium())
    assert out.where("is_high").count() == 0


def test_low_confidence_never_blocks(spark):
    scan = [(1000 + i // 10, "1.1.1.1", f"/p{i}/.env", 404, "masscan/1.3") for i in range(40)]
    out = scorer.score(windows.ema(windows.window_counters(indicators(events(spark, scan)))), medium(conf=0.05))
    assert out.agg(F.max("best")).first()[0] == 49


def test_routes(spark):
    cfg = config.DetectorConfig(whitelist=("10.0.0.0/8", "7.7.7.7"), honeypot_paths=("/trap/",))
    rows = [(1, "10.1.1.1", "/", 200, ""), (1, "7.7.7.7", "/trap/x", 200, ""), (1, "127.0.0.1", "/", 200, ""), (1, "8.8.8.8", "/TRAP/x", 200, ""), (1, "8.8.8.8", "/favicon.ico", 200, ""), (1, "8.8.8.8", "/x", 200, "")]
    got = [r[0] for r in events(spark, rows).orderBy("seq").select(route(cfg)).collect()]
    assert got == ["whitelisted", "whitelisted", "loopback", "honeypot", "skipped", "scored"]


def test_routes_on_clean_paths_and_both_addresses(spark):
    cfg = config.DetectorConfig(whitelist=("2001:db8::/32", "fd00::1"), honeypot_paths=("/trap",))
    rows = [
        (1, "2001:db8::5", "/", 200, "", "8.8.8.8"), (1, "fd00::1", "/", 200, "", ""), (1, "2001:db9::5", "/", 200, "", None),
        (1, "8.8.8.8", "/", 200, "", "127.0.0.9"), (1, "8.8.8.8", "/%74rap", 200, "", ""), (1, "8.8.8.8", "/a/..%2ftrap", 200, "", ""),
        (1, "8.8.8.8", "/.well-known/..%2f..%2fadmin", 200, "", ""), (1, "8.8.8.8", "/.well-known/x?y=1", 200, "", ""), (1, "8.8.8.8", "", 200, "", ""),
    ]
    both = spark.createDataFrame([(i, r[1], r[2], r[5]) for i, r in enumerate(rows)], "seq long, source_ip string, path string, edge_ip string")
    got = [r[0] for r in both.orderBy("seq").select(route(cfg, F.col("edge_ip"))).collect()]
    assert got == ["whitelisted", "whitelisted", "scored", "loopback", "honeypot", "honeypot", "scored", "skipped", "scored"]


def test_networks_of_both_kinds_cover(spark):
    ips = spark.createDataFrame([(x,) for x in ("2001:db8:1::7", "2001:db9::7", "10.1.2.3", "11.1.2.3", "::1", "x:y", "")], "ip string")
    nets = spark.createDataFrame([(x,) for x in ("2001:db8::/32", "10.0.0.0/8", "::1", "bad/99", "fe80::/10")], "net string")
    assert sorted(r["ip"] for r in decision.cover(ips, nets).collect()) == ["10.1.2.3", "2001:db8:1::7", "::1"]
    assert decision.cover(ips, nets.where("net = '10.0.0.0/8'")).count() == 1


def test_ipv6_spellings_are_one_address(spark):
    ips = spark.createDataFrame([(x,) for x in ("2001:0db8:0:0::1", "2001:db8::2", "::ffff", "")], "ip string")
    nets = spark.createDataFrame([(x,) for x in ("2001:db8::1", "0:0::FFFF", "10.0.0.0/x")], "net string")
    assert sorted(r["ip"] for r in decision.cover(ips, nets).collect()) == ["2001:0db8:0:0::1", "::ffff"]
    held = spark.createDataFrame([("2001:db8::9", 5), ("9.9.9.9", 6)], "ip string, expires_at long")
    asked = spark.createDataFrame([("2001:DB8:0::9", False), ("2001:db8:0::1", False), ("2001:db8:0::1", True), ("1::2::3", False), ("9.9.9.9", False), ("fe80::/10", False)], "ip string, force boolean")
    got = sorted((r["ip"], r["outcome"]) for r in decision.block(asked, nets, held).collect())
    assert got == [("1::2::3", "invalid"), ("2001:DB8:0::9", "exists"), ("2001:db8:0::1", "blocked"), ("2001:db8:0::1", "whitelisted"), ("9.9.9.9", "exists"), ("fe80::/10", "blocked")]
    left, outcome = decision.unblock(asked.select("ip").limit(1), held)
    assert [r["ip"] for r in left.collect()] == ["9.9.9.9"] and left.columns == held.columns
    assert [r["outcome"] for r in outcome.collect()] == ["unblocked"]


# Confirmation


def model(rows, c):
    state, out = None, []
    for ts, path, sure in rows:
        state, block = confirm.step(state, ts, path, sure, c)
        out.append(block)
    return out


def burst(ts, n=6):
    return [(ts, f"/api/{'abcd'[i % 4]}", False) for i in range(n)]


@pytest.mark.parametrize(("c", "bursts", "blocks"), [
    (Confirm(2, 30, 5), (1000,), False), (Confirm(2, 5, 1), (1000, 1003), True), (Confirm(2, 3, 1), (1000, 1010), False), (Confirm(1, 30, 5), (1000,), True), (Confirm(3, 10, 2), (1000, 1003), False), (Confirm(3, 10, 2), (1000, 1003, 1006), True),
])
def test_confirmation_cases(c, bursts, blocks):
    assert any(model([e for t in bursts for e in burst(t)], c)) is blocks


def test_confirmation_batch_equals_model(spark):
    r = random.Random(3)
    rows, ts = [], 1000
    for i in range(600):
        ts += r.choice([0, 1, 3, 7, 40])
        rows.append((f"ip{r.randint(1, 3)}", ts, i, r.choice(["/a", "/b"]), r.random() < 0.8, r.random() < 0.02))
    df = spark.createDataFrame(rows, "source_ip string, ts long, seq long, path string, is_high boolean, high_confidence boolean")
    c = Confirm(3, 20, 2)
    want = set()
    for ip in ("ip1", "ip2", "ip3"):
        own = [x for x in rows if x[0] == ip and x[4]]
        want |= {x[2] for x, b in zip(own, model([(x[1], x[3], x[5]) for x in own], c)) if b}
    assert {x["seq"] for x in confirm.confirm_blocks(df, c).collect()} == want


def test_idor_counts_first_seen_ids(spark):
    rows = [(1000 + i, "1.1.1.1", f"/o/{i}", 200, "") for i in range(5)] + [(1058, "1.1.1.1", "/o/0", 200, ""), (1061, "1.1.1.1", "/o/9", 200, "")]
    got = [(r["ids"], r["idor"]) for r in confirm.idor(events(spark, rows), "^/o/", "/o/([0-9]+)", 60, 4, -1).orderBy("seq").collect()]
    assert got == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 15), (5, 15), (4, 0)]


# Behaviour


PROFILES = {
    "api": ([("/r/1", "GET", 200)] * 200 + [("/r/2", "GET", 200)] * 150 + [("/r/3", "GET", 200)] * 50 + [("/r/4", "POST", 201)] * 40, True, True, False),
    "one403": ([("/login", "GET", 403)] * 100, True, False, True),
    "root404": ([("/", "GET", 404)] * 150, True, False, True),
    "favicon": ([("/favicon.ico", "GET", 404)] * 100, True, False, True),
    "css": ([("/a.css", "GET", 404)] * 20 + [("/r/1", "GET", 200)] * 15 + [("/r/2", "GET", 200)] * 15, True, True, False),
    "few": ([("/x", "GET", 200)] * 10, False, False, False),
}


def test_behaviour_profiles(spark):
    rows = [(i, 1000 + i, ip, "nginx_access", m, p, s, "", "") for ip, (seq, *_) in PROFILES.items() for i, (p, m, s) in enumerate(seq)]
    df = spark.createDataFrame(rows, "seq long, ts long, source_ip string, source string, method string, path string, status int, user_agent string, referer string")
    got = {r["source_ip"]: r for r in consistency.consistency(df).collect()}
    for ip, (_, has, benign, error) in PROFILES.items():
        assert (got[ip]["has_samples"], got[ip]["is_benign"]) == (has, benign), ip
        if has:
            assert got[ip]["always_error"] == error, ip


# Decisions


@pytest.mark.parametrize(("score", "votes", "source", "freq", "det", "final", "action"), [
    (100, 19, "global", 50, 50, 66, "alert"), (89, 50, "global", 50, 50, 65.6, "alert"), (100, 1, "global", 50, 50, 46, "ignore"), (100, 100, "private", 50, 50, 58, "alert"),
    (100, 20, "global", 0, 0, 80, "block"), (20, 5, "global", 50, 50, 36, "ignore"), (75, 12, "global", 40, 60, 57, "alert"), (50, 0, "", 50, 50, 44, "ignore"),
])
def test_decisions(spark, score, votes, source, freq, det, final, action):
    df = spark.createDataFrame([("1.1.1.1", float(score), votes, source, freq, det)], "ip string, score double, vote_count int, source string, local_freq int, detector int")
    r = decision.decide(df).first()
    assert abs(r["final_score"] - final) < 1e-9 and r["action"] == action


def test_votes_and_ttl(spark):
    votes = {50: 1.0, 20: 1.0, 19: 0.9, 10: 0.9, 9: 0.75, 5: 0.75, 4: 0.6, 3: 0.6, 2: 0.7, 1: 0.4, 0: 0.7, -1: 0.7}
    df = spark.createDataFrame(list(enumerate(votes)), "i int, v int").orderBy("i")
    assert [r[0] for r in df.select(decision.confidence(F.col("v"), F.lit("global"))).collect()] == list(votes.values())
    rows = spark.createDataFrame([(0, 10000, "cloud"), (1, 100, "cloud"), (2, 0, "cloud"), (3, 0, "local"), (4, 10000, "local")], "i int, t long, s string").orderBy("i")
    assert [r[0] for r in rows.select(decision.ttl(F.col("t"), F.col("s"))).collect()] == [7200, 100, 7200, 3600, 10000]


def test_lists(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "item string")
    got = {r["item"]: r["sources"] for r in features.merge_lists(one("a", " b ", ""), one("b", "c"), one("c", "d", "x"), one("x")).collect()}
    assert got == {"a": "builtin", "b": "builtin+cloud", "c": "cloud+local", "d": "local"}
    got = {r["item"] for r in features.merge_lists(one("a"), one("b"), one("c"), one(), use_builtin=False, use_cloud=False).collect()}
    assert got == {"c"}


def test_whitelist_wins(spark):
    changes = spark.createDataFrame([(1, "black", "1.1.1.1", "add"), (2, "black", "10.0.0.1", "add"), (3, "white", "1.1.1.1", "add"), (4, "black", "bad", "add"), (5, "black", "2.2.2.2", "add"), (6, "black", "2.2.2.2", "del")], "ord long, set string, ip string, op string")
    white = spark.createDataFrame([("10.0.0.0/8",)], "net string")
    got = {(r["set"], r["ip"]): r["op"] for r in decision.cloud_apply(changes, white).collect()}
    assert got == {("black", "1.1.1.1"): "del", ("black", "10.0.0.1"): "filtered", ("white", "1.1.1.1"): "add", ("black", "2.2.2.2"): "del"}


# Configuration


def test_configuration():
    c = config.merge(config.DetectorConfig(), {"high": 60, "medium": 0, "weights": {"method": 4}, "skip_paths": ["/x"]})
    assert (c.high, c.medium, c.weights.method, c.weights.pattern, c.skip_paths) == (60, 30, 4, 5, ("/x",))
    assert config.reload(c, {"low": 99}) is c
    assert config.sanitize_paths(["/a/./b/", "x", "/a/../b", " /c "]) == ["/a/b/", "/c"]
    with pytest.raises(ValueError):
        config.decision_weights(0.9, 0.9, 0.9)
    assert config.feature_list("x")["items"] == ["x"] and config.feature_list(None)["items"] == []


def test_intel_reader(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"ip": "1.1.1.1", "score": 90, "vote_count": 3, "source": "global"}\n{"ip": "2.2.2.2", "score": "x"}\n')
    assert src.read_intel(spark, str(tmp_path)).count() == 2
    assert len(COUNTERS) == 16
