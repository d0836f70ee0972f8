"""Distinct counts, averages and behaviour as of each event, against models that go event by event."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import events

from tidewatch.operators import consistency, windows
from tidewatch.operators.indicators import indicators, route


def some(seed, n=700, ips=3, gap=(0, 0, 1, 1, 2, 5, 70)):
    r = random.Random(seed)
    ts, out = 3500, []
    for _ in range(n):
        ts += r.choice(gap)
        out.append((ts, f"9.9.9.{r.randint(1, ips)}", r.choice(["/a", "/a/b", "/b/1", "/c.css", "/robots.txt", "/x/" + "klm"[r.randint(0, 2)]]), r.choice([200, 200, 302, 404, 403, 500]), "curl/8"))
    return out


def test_distinct_ports_by_sweep(spark):
    r = random.Random(4)
    rows, ts = [], 3000
    for i in range(900):
        ts += r.choice([0, 0, 1, 2, 30, 119, 120])
        rows.append((i, f"ip{r.randint(1, 2)}", r.randint(1, 25), ts))
    df = spark.createDataFrame(rows, "seq long, src_ip string, dst_port int, ts long")
    got = {x["seq"]: x for x in windows.trailing_distinct(df, "src_ip", {"ports": F.lit(True)}, F.col("dst_port"), [5, 30, 120]).collect()}
    assert len(got) == 900
    for i, ip, _, ts in rows:
        for w in (5, 30, 120):
            assert got[i][f"ports_{w}"] == len({p for j, q, p, t in rows[: i + 1] if q == ip and t > ts - w}), (i, w)


def test_no_list_in_the_sweep(spark):
    plan = windows.distinct_bases(events(spark, some(1, 10)))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_average_of_an_address_that_never_idles(spark):
    rows = [(3000 + i // 3, "1.1.1.1", "/", 200, "") for i in range(40_000)] + [(3000 + 7 * i, "2.2.2.2", "/", 200, "") for i in range(50)]
    rows.sort()
    got = {r["seq"]: (r["seen"], r["ema"]) for r in windows.ema(events(spark, rows)).select("seq", "seen", "ema").collect()}
    state = {}
    for i, (ts, ip, *_) in enumerate(rows):
        e, n, last, seen = state.get(ip, (0.0, 0, None, 0))
        n = n + 1 if ts == last else 1
        state[ip] = e, n, last, seen = 0.95 * e + 0.05 * n / 10, n, ts, seen + 1
        assert got[i][0] == seen and abs(got[i][1] - e) < 1e-9


def model(ring, t=consistency.Shape()):
    """The parts of C1-C8 over a list of (path, status, method), from the definitions."""
    first = lambda p: next((x for x in p.split("?")[0].split("/") if x), "/")
    segs, paths, n = [first(p) for p, _, _ in ring], [p for p, _, _ in ring], len(ring)
    runs = sum(i == 0 or segs[i] != segs[i - 1] for i in range(n))
    k = max(n // 3, 1)
    early = set(paths[:k])
    count = {p: paths.count(p) for p in set(paths)}
    top = sorted(count, key=lambda p: (-count[p], p))[:5]
    cvs = []
    for p in count:
        if count[p] >= 3:
            s = [x for q, x, _ in ring if q == p]
            c = [s.count(x) for x in set(s)]
            m = sum(c) / len(c)
            cvs.append((sum((x - m) ** 2 for x in c) / (len(c) - 1)) ** 0.5 / m if len(c) > 1 else 0.0)
    cv = round(sum(cvs) / len(cvs), 3) if cvs else 0.0
    cover = sum(count[p] for p in top) / n
    share = len(early) / len(count)
    late = sum(p not in early for p in paths[n - k :]) / k
    fails = any((p == "/robots.txt" or not p.endswith(".css")) and count[p] >= (10 if p == "/robots.txt" else 5) and all(s >= 400 for q, s, _ in ring if q == p) for p in top)
    score = 2 * (n / runs >= t.run or max(map(segs.count, segs)) / n >= t.dominant) + 2 * (share >= t.early and late <= t.late) + 2 * (cover >= t.cover) + (cv < t.cv) + 1
    score -= 5 * fails + 3 * (fails and len(count) < 3) + 3 * (share < 0.5 and late > 0.7 and cover < 0.4)
    return n, score, n >= t.least and score >= t.benign


@pytest.mark.parametrize("keep, piece", [(512, 8192), (30, 64), (7, 16)])
def test_behaviour_as_of_each_event(spark, monkeypatch, keep, piece):
    monkeypatch.setattr(consistency, "PIECE", piece)
    rows = some(8, 500, 2)
    got = {r["seq"]: (r["total"], r["score"], r["is_benign"]) for r in consistency.as_of(events(spark, rows), keep=keep).collect()}
    past = {}
    for i, (_, ip, path, status, _) in enumerate(rows):
        past.setdefault(ip, []).append((path, status, "GET"))
        assert got[i] == model(past[ip][-keep:]), i
    half = events(spark, rows).where("seq < 250")
    assert {r["seq"]: (r["total"], r["score"], r["is_benign"]) for r in consistency.as_of(half, keep=keep).collect()} == {i: got[i] for i in range(250)}


def test_last_verdict_is_that_of_the_table(spark):
    rows = events(spark, some(9, 900, 2))
    last = rows.groupBy("source_ip").agg(F.max("seq").alias("seq"))
    now = {r["source_ip"]: (r["total"], r["score"], r["is_benign"]) for r in consistency.as_of(rows).join(last, "seq").collect()}
    assert now == {r["source_ip"]: (r["total"], r["score"], r["is_benign"]) for r in consistency.consistency(rows).collect()}


def test_only_what_is_asked(spark):
    rows = events(spark, some(10, 100, 2))
    assert sorted(r["seq"] for r in consistency.as_of(rows, asked=F.col("status") == 404).collect()) == sorted(r["seq"] for r in rows.where("status = 404").collect())
    assert consistency.as_of(rows.limit(0)).count() == 0


def test_one_path_however_it_is_written(spark):
    rows = events(spark, [(1, "1.1.1.1", p, 404, "x") for p in ("/admin/login", "/%61dmin/login", "/admin/./login", "//admin/login?x=1", "/A/../admin/login", "/%2561dmin/login")])
    got = windows.distinct_bases(indicators(rows)).orderBy("seq").collect()
    assert [r["d404_10"] for r in got] == [1] * 6 and [r["sens"] for r in got] == [1] * 6
    assert [r["trav"] for r in got] == [0, 0, 0, 0, 1, 0] and {r["path"] for r in got} == {"/admin/login"}


def test_one_long_entity_stops_nothing(spark):
    paths = ["/x?a=&#" + "1" * 5000 + ";", "/x?a=&#x" + "f" * 5000 + ";", "/x?a=&#" + "0" * 5000 + "60;script&#62;"]
    got = indicators(events(spark, [(1, "1.1.1.1", p, 200, "x") for p in paths])).orderBy("seq").collect()
    assert [r["danger"] for r in got] == [0, 0, 1] and [r["path"] for r in got] == ["/x"] * 3
    assert events(spark, [(1, "1.1.1.1", paths[0], 200, "x")]).select(route().alias("r")).first()["r"] == "scored"
