"""Registered queries: each operator over the whole given tables, with the DuckDB text of the same result where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import config, features
from ..functions import decoding, parsers
from ..functions import scalars as S
from ..operators import baseline, confirm, consistency, decision, detect, indicators, layers, reports, scorer, windows
from ..session import scratch, share_code, written
from ..sources import access as src
from ..streaming import learning, processor, sets, settings, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(share_code(spark), sf_dir)
    return f


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


def _indicated(spark, d):
    return indicators.indicators(src.access(spark, d))


def _clean(spark, d):
    return indicators.cleaned(src.access(spark, d)).drop("_asked")


def _now(df: DataFrame) -> int:
    return int(df.agg(F.max("ts")).first()[0] or 0)


# Parsers (2.2)


@query
def access_view(spark, d):
    return src.access(spark, d)


def _parsed(spark, d, name, text=None):
    lines = src.lines(src.access(spark, d))
    e = parsers.PARSERS[name](text(F.col("value")) if text else F.col("value"), F.lit(0))
    return lines.select("seq", e.alias("e")).where("e is not null").select("seq", "e.ts", "e.ts_parse_ok", "e.source", "e.source_ip", "e.method", "e.path", "e.status", "e.bytes_sent", "e.referer", "e.user_agent", "e.edge_ip", "e.client_ip_from")


@query
def parse_nginx(spark, d):
    return _parsed(spark, d, "nginx")


@query
def parse_apache(spark, d):
    return _parsed(spark, d, "apache")


@query
def parse_tomcat(spark, d):
    return _parsed(spark, d, "tomcat")


@query
def parse_ext_ip_pick(spark, d):
    """Extended lines made from the events, with each header missing in turn."""
    n = F.col("seq") % 4
    quote = lambda c: F.concat(F.lit(' "'), c, F.lit('"'))
    line = F.regexp_replace("value", "^(\\S+) - ", "$1 54321 - ")
    tail = F.concat(quote(F.when(n >= 1, F.lit(" 10.0.0.1 , 172.16.0.1")).otherwise("-")), quote(F.when(n == 3, F.lit("6.6.6.6")).otherwise("-")), quote(F.when(n == 2, F.lit("8.8.8.8")).otherwise("")))
    lines = src.lines(src.access(spark, d)).select("seq", F.concat(line, tail).alias("value"))
    e = parsers.nginx(F.col("value"), F.lit(0))
    return lines.select("seq", e.alias("e")).select("seq", "e.source_ip", "e.edge_ip", "e.client_ip_from", "e.status", "e.path")


@query
def parse_auth(spark, d):
    """sshd lines made from the events; the year is that of the reference date."""
    a = src.access(spark, d)
    when = F.date_format(F.timestamp_seconds("ts"), "MMM d HH:mm:ss")
    what = F.when(F.col("seq") % 3 == 0, F.lit("Failed password for invalid user root from ")).when(F.col("seq") % 3 == 1, F.lit("Accepted password for admin from ")).otherwise(F.lit("Connection closed by "))
    tail = F.when(F.col("seq") % 3 < 2, F.lit(" port 12345 ssh2")).otherwise(F.lit(" [preauth]"))
    lines = a.select("seq", F.concat(when, F.lit(" host sshd[1234]: "), what, "source_ip", tail).alias("value"))
    e = parsers.linux_auth(F.col("value"), F.lit(src.EPOCH + 40 * 86400))
    return lines.select("seq", e.alias("e")).select("seq", "e.ts", "e.source_ip", "e.auth_user", "e.auth_action", S.is_auth_failure(F.col("e.auth_action")).alias("failed"))


@query
def parse_custom(spark, d):
    """A user's regex over the same lines: address, time, request, status."""
    p = parsers.custom(r'^(\S+) - - \[([^\]]+)\] "([^"]*)" (\d+)', {"ip": 1, "time": 2, "request": 3, "status": 4, "bytes": 9})
    e = p(F.col("value"), F.lit(0))
    return src.lines(src.access(spark, d)).select("seq", e.alias("e")).select("seq", "e.ts", "e.source_ip", "e.method", "e.path", "e.status", "e.bytes_sent")


@query
def parse_portscan(spark, d):
    """Packet-filter lines made from the events; every tenth has a port out of range."""
    p = src.port_events(src.access(spark, d))
    when = F.date_format(F.timestamp_seconds("ts"), "MMM d HH:mm:ss")
    port = F.when(F.col("seq") % 10 == 0, 70000).otherwise(F.col("dst_port")).cast("string")
    lines = p.select("seq", F.concat(when, F.lit(" kernel: [PORT_SCAN]: IN=eth0 SRC="), "src_ip", F.lit(" DST=10.0.0.5 PROTO=TCP SPT=12345 DPT="), port).alias("value"))
    e = parsers.port_scan(F.col("value"), F.lit(src.EPOCH + 40 * 86400))
    return lines.select("seq", e.alias("e")).where("e is not null").select("seq", "e.src_ip", "e.dst_port", "e.ts")


@query
def unparsable(spark, d):
    """Texts of documents are no log lines: how many each parser rejects."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("value"))
    flags = {n: F.count_if(p(F.col("value"), F.lit(0)).isNull()).alias(n) for n, p in parsers.PARSERS.items()}
    return docs.agg(F.count("*").alias("lines"), *flags.values())


# Scalars (2.3)


def _paths(spark, d):
    """Distinct request paths, and URLs of pages without their host."""
    a = src.access(spark, d).select("path")
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.regexp_replace("url", "^[a-z]+://[^/]+", "").alias("path"))
    return a.unionByName(p).distinct()


@query
def norm404(spark, d):
    return _paths(spark, d).select("path", S.normalize_404_path(F.col("path")).alias("base"))


@query
def sens_path(spark, d):
    return _paths(spark, d).select("path", S.hit_sensitive_path(F.col("path")).alias("hit"))


@query
def first_segment(spark, d):
    return _paths(spark, d).select("path", S.first_segment(F.col("path")).alias("seg"))


@query
def static_res(spark, d):
    return _paths(spark, d).select("path", S.is_static_resource(F.col("path")).alias("static"))


@query
def path_route(spark, d):
    return src.access(spark, d).groupBy(indicators.route().alias("route")).agg(F.count("*").alias("n"))


@query
def bot_ua(spark, d):
    ua = F.col("user_agent")
    return src.access(spark, d).groupBy("user_agent").agg(F.count("*").alias("n")).select("user_agent", "n", S.is_bot_agent(ua).alias("bot"), S.is_browser_agent(ua).alias("browser"))


@query
def method_class(spark, d):
    m = F.col("method")
    rows = src.access(spark, d).groupBy("method").agg(F.count("*").alias("n"))
    return rows.select("method", "n", S.method_code(m).alias("code"), S.is_dangerous_method(m).alias("dangerous"), S.is_malformed(m, F.lit("/")).alias("malformed"))


@query
def danger_patterns(spark, d):
    """patterns in the fully decoded paths."""
    low = F.lower("text")
    hits = F.array_compact(F.array(*[F.when(low.contains(p), F.lit(p)) for p in features.DANGEROUS_PATTERNS]))
    seen = _paths(spark, d).select("path", decoding.decode_path(F.col("path")).alias("text"))
    return seen.select("path", F.size(hits).cast("long").alias("n"), F.array_join(F.array_sort(hits), ",").alias("hits"))


@query
def decode_path(spark, d):
    """All rounds of decoding, the climbing test and the cleaned path."""
    p = F.col("path")
    n = decoding.normalize_request_path(p)
    return _paths(spark, d).select("path", decoding.decode_path(p).alias("decoded"), n.alias("n")).select("path", "decoded", F.col("n.path").alias("cleaned"), F.col("n.traversal").alias("climbs"))


@query
def body_scan(spark, d):
    """Documents as form, JSON and XML bodies, scanned whole."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = F.element_at(F.array(*[F.lit(k) for k in features.BODY_TYPES]), (F.col("doc_id") % 5 + 1).cast("int"))
    body = F.when(F.col("doc_id") % 5 == 0, F.to_json(F.struct("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", kind.alias("kind"), decoding.body_scan(kind, body, most=None).alias("s")).select("doc_id", "kind", "s.*")


@query
def upload_check(spark, d):
    """File names made from the last segment of paths."""
    name = F.substring_index(S.without_query(F.col("path")), "/", -1)
    files = _paths(spark, d).select("path", F.explode(F.array(name, F.concat(name, F.lit(".php")), F.concat(name, F.lit(".jpg.PHP")), F.concat(name, F.lit(".jsp.png")))).alias("file_name"))
    return files.distinct().select("path", "file_name", S.upload_blocked(F.col("file_name"), F.lit("image/png")).alias("blocked"))


@query
def ip_predicates(spark, d):
    ip = F.col("source_ip")
    rows = src.access(spark, d).groupBy("source_ip").agg(F.count("*").alias("n"))
    return rows.select("source_ip", "n", S.ip_number(ip).alias("number"), S.is_private(ip).alias("private"), S.is_loopback(ip).alias("loopback"), S.in_cidr(ip, "198.51.100.0/29").alias("in_net"), S.to_cidr(ip).alias("cidr"))


# Indicators and windows (2.5)


@query
def event_indicators(spark, d):
    return _indicated(spark, d).select("seq", *indicators.COUNTERS)


@query
def win_counters_10(spark, d):
    return windows.trailing_counters(_indicated(spark, d), (10,)).select("seq", *[f"{c}_10" for c in indicators.COUNTERS])


@query
def win_counters_30(spark, d):
    return windows.trailing_counters(_indicated(spark, d), (30,)).select("seq", *[f"{c}_30" for c in indicators.COUNTERS])


@query
def win_counters_60(spark, d):
    return windows.trailing_counters(_indicated(spark, d), (60,)).select("seq", *[f"{c}_60" for c in indicators.COUNTERS])


@query
def distinct_bases(spark, d):
    return windows.distinct_bases(_clean(spark, d)).select("seq", "d404_10", "d4xx_10", "d404_30", "d4xx_30", "d404_60", "d4xx_60")


@query
def ip_snapshot_ticks(spark, d):
    return windows.snapshots(_indicated(spark, d), 60).select("tick", "source_ip", *indicators.COUNTERS)


@query
def idle_sessions(spark, d):
    """Sessions of all requests between gaps of five seconds: start, end and events."""
    s = windows.sessions(src.access(spark, d), idle=5)
    return s.groupBy("source_ip", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


@query
def port_scan(spark, d):
    return windows.port_scans(src.port_events(src.access(spark, d)))


@query
def buckets_5m(spark, d):
    return windows.buckets(src.access(spark, d))


@query
def ring512(spark, d):
    return windows.latest(_clean(spark, d)).select("source_ip", "pos", "seq", "path", "status")


@query
def ip_ema(spark, d):
    return windows.ema(src.access(spark, d)).select("seq", "seen", *_r("ema"))


# Baseline (2.6)


def _tick_samples(spark, d):
    return baseline.samples(windows.snapshots(_indicated(spark, d), 60), 60)


@query
def attacker_filter(spark, d):
    s = windows.snapshots(_indicated(spark, d), 60)
    return s.groupBy("source_ip").agg(F.count("*").alias("ticks"), F.count_if(baseline.attacker()).alias("dropped"))


@query
def percentiles(spark, d):
    k = ["tick", "dim"]
    return baseline.percentiles(baseline.histogram(_tick_samples(spark, d), k), k).select("tick", "dim", *_r("p50", "p95", "p99"), "n")


@query
def mad_trim(spark, d):
    k = ["tick", "dim"]
    return baseline.percentiles(baseline.mad_trim(baseline.histogram(_tick_samples(spark, d), k), k), k).select("tick", "dim", *_r("p50", "p95", "p99"), "n")


@query
def p99_trim(spark, d):
    k = ["dim"]
    h = baseline.histogram(_tick_samples(spark, d), k)
    return baseline.percentiles(baseline.p99_trim(h, k, 1.0), k).select("dim", *_r("p50", "p95", "p99"), "n")


def _baselines(spark, d):
    ticks = baseline.tick_percentiles(windows.snapshots(_indicated(spark, d), 60), 60)
    return baseline.baselines(ticks, F.lit(src.EPOCH))


@query
def baseline_decay(spark, d):
    return _baselines(spark, d).select("tick", "dim", *_r("p50", "p95", "p99"), "n")


@query
def baseline_thresholds(spark, d):
    q = _baselines(spark, d).where("dim = 'qps'")
    th = baseline.thresholds(F.col("p50"), F.col("p95"), F.col("n"), F.lit(0.5))
    return q.select("tick", *[F.round(F.element_at(th, i), 6).alias(f"th{i}") for i in (1, 2, 3)], F.round(baseline.min_qps(F.col("p95"), F.col("n")), 6).alias("min_qps"), F.round(baseline.guard_qps(F.col("p95"), F.col("n")), 6).alias("guard_qps"))


@query
def asof_baseline(spark, d):
    return baseline.as_of(src.access(spark, d), _baselines(spark, d)).select("seq", "tick", *_r("p50", "p95"), "n")


@query
def adaptive_lookback(spark, d):
    return baseline.lookback(windows.buckets(src.access(spark, d)))


@query
def preload_baseline(spark, d):
    return baseline.preload_percentiles(windows.buckets(src.access(spark, d))).select("dim", *_r("p50", "p95", "p99"), "n")


@query
def ip_diversity(spark, d):
    return baseline.ip_diversity(src.access(spark, d)).select("unique_ips", *_r("top1_ratio", "top3_ratio"), "suspicious")


# Scores (2.7)


def _scored(spark, d):
    a = _indicated(spark, d).where(indicators.route(clean=True) == "scored")
    learnt = baseline.preload(windows.buckets(src.access(spark, d)))
    wide = windows.ema(windows.window_counters(a))
    return scorer.score(written(wide), scorer.literals(learnt))


@query
def score_detail(spark, d):
    return _scored(spark, d).select("seq", "score_10", "score_30", "score_60", "dims_10", "dims_30", "dims_60", "best", "final", "is_high", "high_confidence", "freq", "detect")


@query
def local_scores(spark, d):
    return scorer.local_scores(_scored(spark, d))


@query
def gated_scores(spark, d):
    """The consistency gate: high scores of addresses that are benign as of the event fall to medium."""
    e = written(_scored(spark, d).select("seq", "ts", "source_ip", "path", "status", "method", "final", "is_high", F.col("final").alias("raw")))
    shape = consistency.as_of(e, asked=F.col("is_high"))
    return scorer.gated(e.join(shape.select("seq", "is_benign"), "seq", "left"), F.col("is_benign")).select("seq", "raw", F.col("final").alias("gated"))


@query
def recent_scores(spark, d):
    a = src.access(spark, d)
    e = written(windows.ema(_indicated(spark, d)))
    return scorer.recent_scores(e, F.lit(_now(a)), scorer.literals(baseline.preload(windows.buckets(a))))


@query
def learnt_baseline(spark, d):
    """The baseline of each event's moment, or the defaults until it is ready."""
    e = baseline.learnt(src.access(spark, d), written(_baselines(spark, d)), F.lit(src.EPOCH), "b")
    return e.select("seq", "b.conf", *[F.round(f"b.{c}", 6).alias(c) for c in ("qps_p95", "r4xx_p95", "own_qps_p95")])


@query
def score_log(spark, d):
    return reports.detail(_scored(spark, d))


# Behaviour (2.8)


def _ring(spark, d):
    return windows.latest(_clean(spark, d))


@query
def prefix_runs(spark, d):
    return consistency.prefix_runs(_ring(spark, d)).select("source_ip", *_r("avg_run", "dominant"))


@query
def novelty(spark, d):
    return consistency.novelty(_ring(spark, d)).select("source_ip", *_r("early", "late"))


@query
def top5_cover(spark, d):
    return consistency.top_cover(_ring(spark, d)).select("source_ip", *_r("cover"))


@query
def status_cv(spark, d):
    return consistency.status_cv(_ring(spark, d)).select("source_ip", F.round("cv", 2).alias("cv"))


@query
def method_mix(spark, d):
    return consistency.method_mix(_ring(spark, d)).select("source_ip", *_r("get", "post", "unusual"), "method_ok")


@query
def always_error(spark, d):
    return consistency.always_error(_ring(spark, d))


@query
def consistency_score(spark, d):
    return consistency.consistency(_clean(spark, d)).select("source_ip", "total", "has_samples", "score", "is_benign")


@query
def shape_as_of(spark, d):
    """The verdict on an address as of each of its events."""
    return consistency.as_of(_clean(spark, d))


# Decisions and state (2.9)


def _local(spark, d):
    """Local scores that SQL can repeat: failures as frequency, sensitive hits as detector score."""
    a = _indicated(spark, d)
    return a.groupBy(F.col("source_ip").alias("ip")).agg(F.least(F.sum("c4xx") % 101, F.lit(100)).alias("freq"), F.least(F.sum("sens"), F.lit(100)).alias("detector"), F.max("ts").alias("last_seen"))


@query
def decide_all(spark, d):
    a = src.access(spark, d)
    return decision.decide_all(src.intel(a), _local(spark, d), F.lit(_now(a)), 5).select("ip", "vote_count", *_r("cloud_score", "cloud_confidence", "effective_cloud", "local_freq", "detector", "final_score"), "fast_path", "action")


@query
def consensus_fast_path(spark, d):
    x = src.intel(src.access(spark, d)).select("ip", F.lit(95.0).alias("score"), (F.col("vote_count") + 10).alias("vote_count"), "source", F.lit(50).alias("local_freq"), F.lit(50).alias("detector"))
    return decision.decide(x).select("ip", "fast_path", *_r("final_score"), "action")


@query
def score_range(spark, d):
    a = src.access(spark, d)
    return reports.score_range(decision.decide_all(src.intel(a), _local(spark, d), F.lit(_now(a)), 5)).select(*_r("least", "most"))


def _requests(a):
    return a.where("status = 404").select(F.col("seq").alias("ord"), F.col("source_ip").alias("ip"), F.when(F.col("seq") % 4 < 2, "cloud").otherwise("local").alias("source"), (F.col("seq") % 5 * 3000).cast("long").alias("ttl"), F.col("ts").alias("at"))


@query
def ttl_active(spark, d):
    a = src.access(spark, d)
    return decision.active(decision.entries(_requests(a)), F.lit(_now(a) + 3000))


def _nets(spark):
    return spark.range(1).select(F.explode(F.array(F.lit("198.51.100.0/30"), F.lit("198.51.100.9"), F.lit("10.0.0.0/8"))).alias("net"))


@query
def block_apply(spark, d):
    a = src.access(spark, d)
    ips = a.select(F.col("source_ip").alias("ip")).distinct().unionByName(a.select(F.concat(F.col("source_ip"), F.lit("x")).alias("ip")).distinct())
    requests = ips.withColumn("force", F.col("ip").endswith("1"))
    known = a.where("status = 500").select(F.col("source_ip").alias("ip")).distinct().where(F.col("ip").endswith("5"))
    return decision.block(requests, _nets(spark), known)


@query
def unblock(spark, d):
    a = src.access(spark, d)
    known = a.where("status = 500").select(F.col("source_ip").alias("ip")).distinct()
    asked = a.where("source = 'tomcat_access'").select(F.col("source_ip").alias("ip")).distinct()
    left, done = decision.unblock(asked, known)
    return done.unionByName(left.select("ip", F.lit("kept").alias("outcome")))


def _changes(a):
    return a.select(F.col("seq").alias("ord"), F.when(F.col("seq") % 3 == 0, "white").otherwise("black").alias("set"), F.col("source_ip").alias("ip"), F.when(F.col("status") == 302, "del").otherwise("add").alias("op"))


@query
def cloud_apply(spark, d):
    return decision.cloud_apply(_changes(src.access(spark, d)), _nets(spark))


@query
def set_state(spark, d):
    return decision.set_state(_changes(src.access(spark, d)).withColumn("timeout", F.lit(3600)))


@query
def whitelist_sync(spark, d):
    a = src.access(spark, d)
    old = a.where("source = 'apache_access'").select(F.col("source_ip").alias("net")).distinct()
    known = a.select(F.col("source_ip").alias("ip")).distinct()
    return decision.whitelist_sync(old, _nets(spark), known)


@query
def diff_apply(spark, d):
    a = src.access(spark, d)
    inc = a.select("seq", F.when(F.col("status") == 404, "del").otherwise("add").alias("op"), F.col("source_ip").alias("ip"), (F.col("seq") % 101).cast("double").alias("score"))
    base = src.intel(a).select("ip", "score")
    return decision.apply_diff(base, inc, 500, True)


@query
def layered_intel(spark, d):
    """Two layers of scores made from the requests, from an agent whose shared snapshot is old: that snapshot, later steps, the tenant's own over them."""
    a = src.access(spark, d)
    row = lambda df, layer, whole, seq, score, votes: df.select(F.lit(layer).alias("layer"), F.lit(whole).alias("whole"), seq.alias("seq"), F.col("source_ip").alias("ip"), score.cast("double").alias("score"), votes.cast("int").alias("vote_count"), F.lit("global" if layer == "global" else "private").alias("source"))
    n, seq = F.substring_index("source_ip", ".", -1).cast("int"), F.col("seq")
    feed = row(a.select("source_ip").distinct(), "global", True, F.lit(400).cast("long"), n * 6, n)
    feed = feed.unionByName(row(a.where("status = 404"), "global", False, seq, seq % 101, seq % 25)).unionByName(row(a.where("status = 500"), "tenant", False, seq, seq * 7 % 101, seq % 25))
    white = a.where("status = 403").select("seq", F.col("source_ip").alias("ip"), F.when(seq % 2 == 0, "add").otherwise("del").alias("op"))
    return layers.applied(feed, white, _local(spark, d), F.lit(_now(a)), layers.Cursor("old", 300, 200), layers.Server("new")).select("ip", "layer", *_r("cloud_score", "final_score"), "action")


@query
def set_table(spark, d):
    """The lists as a versioned table: the requests as changes in five batches, each given twice, and the members at the end."""
    a = src.access(spark, d)
    top = a.agg(F.max("seq")).first()[0] or 0
    asked = a.select(F.col("seq").alias("ord"), F.when(F.col("seq") % 3 == 0, "white").otherwise("black").alias("set"), F.col("source_ip").alias("ip"), F.when(F.col("status") == 302, "del").otherwise("add").alias("op"), F.when(F.col("seq") % 2 == 0, "cloud").otherwise("local").alias("source"), F.col("ts").alias("at"), (F.col("seq") % 7 * 1500).cast("long").alias("seconds"))
    rows = written(sets.entries(asked).withColumn("part", F.floor(F.col("ord") * 5 / F.lit(top + 1))))
    table = sets.SetTable(spark, scratch(spark), whole_every=2)
    for k in range(5):
        for _ in range(2):
            table.apply(rows.where(F.col("part") == k).drop("part"), k)
    return table.current(F.lit(_now(a) + 2000)).withColumn("expires_at", F.coalesce("expires_at", F.lit(-1).cast("long")))


def _streamed(rows: DataFrame, key: str, lateness: int, run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What a stream over the rows puts out: three micro-batches in order of time, then a row of no address that moves the watermark past all."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    ends = rows.agg(F.min("ts"), F.max("ts")).first()
    third = ((ends[1] or 0) - (ends[0] or 0)) // 3 + 1
    last = spark.range(1).select(*[F.lit(f"{key}:end").alias(c) if c == key else F.lit((ends[1] or 0) + 10 * lateness + 10**6).alias(c) if c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    last = last.withColumn("seq", F.lit(-1).cast("long"))
    for k in range(3):
        rows.where(F.floor((F.col("ts") - F.lit(ends[0] or 0)) / third) == k).write.mode("append").parquet(f"{path}/in/{k}")
    last.select(*rows.columns).write.parquet(f"{path}/in/3")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 8).parquet(f"{path}/in")
    found = run(stream, f"{lateness} seconds")
    q = found.writeStream.option("checkpointLocation", f"{path}/place").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start()
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out").where(~F.col(key).endswith(":end"))


@query
def stream_port_scan(spark, d):
    """Port scans found by a stream with keyed state; files may come in any order, so the watermark waits for all of them."""
    p = src.port_events(src.access(spark, d))
    span = p.agg(F.max("ts") - F.min("ts")).first()[0] or 0
    return _streamed(p, "src_ip", int(span) + 60, lambda s, late: stateful.port_scans(s, lateness=late))


@query
def stream_snapshots(spark, d):
    """W6 by a stream: per tick and address the counters of the last minute."""
    e = _indicated(spark, d).select("seq", "ts", "source_ip", *indicators.COUNTERS)
    span = e.agg(F.max("ts") - F.min("ts")).first()[0] or 0
    return _streamed(e, "source_ip", int(span) + 60, lambda s, late: processor.snapshots(s, lateness=late))


def _steps(rows: DataFrame, run: Callable[[DataFrame], DataStreamWriter], between: Callable[[int], None] = lambda k: None, last: DataFrame | None = None) -> None:
    """A stream over the rows that stops and goes on: each run gets the next third in order of time, a fourth one `last`."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    ends = rows.agg(F.min("ts"), F.max("ts")).first()
    third = ((ends[1] or 0) - (ends[0] or 0)) // 3 + 1
    parts = [rows.where(F.floor((F.col("ts") - F.lit(ends[0] or 0)) / third) == k) for k in range(3)]
    for k, part in enumerate([*parts, last] if last is not None else parts):
        part.write.parquet(f"{path}/in/{k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        run(stream).option("checkpointLocation", f"{path}/place").trigger(availableNow=True).start().awaitTermination()
        between(k)


@query
def stream_baseline(spark, d):
    """B10 by a stream: the baseline after each tick, learnt in runs that go on from the table; a last event far ahead moves the watermark past all."""
    e = _indicated(spark, d).select("seq", "ts", "source_ip", *indicators.COUNTERS)
    zero = [F.lit(0).cast("long").alias(c) for c in indicators.COUNTERS]
    last = e.agg(F.max("seq").alias("seq"), (F.max("ts") + 10**6).alias("ts"), F.lit("").alias("source_ip"), *zero).where("ts is not null")
    table = learning.BaselineTable(spark, scratch(spark))
    _steps(e, lambda s: processor.snapshots(s, lateness="10 seconds", first=True).writeStream.foreachBatch(table.apply), last=last)
    return table.ticks().select("tick", "dim", *_r("p50", "p95", "p99"), "n")


@query
def stream_settings(spark, d):
    """Indicators of a stream whose settings change: the built-in lists, then others with a fetched agent, then a version that does not hold."""
    a, kept = src.access(spark, d), settings.Settings(spark, scratch(spark), lambda s: (1, s.createDataFrame([("ua", "okhttp/4", 0)], "category string, value string, ord long")))
    changes = [
        {"sensitive_paths": {"items": ["orders", "users"], "builtin": False}, "bot_agents": {"excludes": ["sqlmap"]}, "known_clients": {"excludes": ["okhttp"]}},
        {"high": 5, "medium": 30},
    ]
    path = scratch(spark)
    work = lambda batch, cfg, k: indicators.indicators(batch, cfg).select("seq", "sens", "bot", F.lit(k).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{path}/{k}")
    _steps(a, lambda s: s.writeStream.foreachBatch(kept.each(work)), lambda k: kept.offer(changes[k]) if k < len(changes) else None)
    out = spark.read.schema("seq long, sens long, bot long, batch long").option("recursiveFileLookup", True).parquet(path)
    return out.groupBy("batch").agg(F.count("*").alias("events"), F.sum("sens").alias("sens"), F.sum("bot").alias("bot"))


@query
def confirm_blocks(spark, d):
    """Confirmation over failed requests as high scores."""
    a = _indicated(spark, d).withColumns({"is_high": F.col("status") >= 403, "high_confidence": F.lit(False)})
    return confirm.confirm_blocks(a.select("source_ip", "ts", "seq", "path", "is_high", "high_confidence"))


#: Settings that the log view exercises: a trap, a trusted network and the enumeration of orders.
_CFG = config.DetectorConfig(honeypot_paths=("/phpmyadmin/",), trusted_subnets=("198.51.100.0/30",))
_ORDERS = ("^/api/v1/orders/", "/orders/([0-9]+)", 20)


@query
def detected(spark, d):
    """End to end: every event's score with learnt baselines, enumeration, the gate and traps."""
    return detect.detect(src.access(spark, d), _CFG, _ORDERS)


@query
def scored_blocks(spark, d):
    """End to end: the block requests of the detected events, and which of them are accepted."""
    return detect.blocks(written(detect.detect(src.access(spark, d), _CFG, _ORDERS)), _CFG)


@query
def idor(spark, d):
    """Distinct objects per address: the event number stands for the object of an order path."""
    a = src.access(spark, d).where("path like '/api/v1/orders/%'").withColumn("path", F.concat(F.lit("/api/v1/orders/"), F.col("seq") % 97))
    return confirm.idor(a, "^/api/v1/orders/", "/orders/([0-9]+)", 60, 3)


# Reports and lists (2.10)


def _judged(spark, d):
    """Events with a final score that SQL can repeat."""
    a = _indicated(spark, d)
    final = (F.col("sens") * 30 + F.col("danger") * 20 + F.col("bot") * 10 + F.col("c4xx") * 5).cast("long")
    return a.withColumn("final", final).withColumn("is_high", final >= 50)


@query
def detector_report(spark, d):
    return reports.report(_judged(spark, d), 600)


@query
def logged_report(spark, d):
    return reports.logged_report(_judged(spark, d))


@query
def per_source(spark, d):
    return reports.per_source(src.access(spark, d))


@query
def blocked_rollup(spark, d):
    return reports.blocked_rollup(_judged(spark, d).where("is_high"))


@query
def top_blocked(spark, d):
    return reports.top_blocked(_judged(spark, d).where("final > 0"))


@query
def sampled(spark, d):
    return reports.sampled(_judged(spark, d), 10).select("seq", "source_ip", "final")


@query
def max_score_payload(spark, d):
    return reports.max_score(_judged(spark, d))


@query
def feature_stats(spark, d):
    return reports.feature_stats(_judged(spark, d))


@query
def feature_sketches(spark, d):
    """A6 from sketches of each period, added up."""
    return reports.sketched_stats(reports.feature_sketches(_judged(spark, d)))


@query
def dimension_hits(spark, d):
    """A1: hits by dimension, with the counters of two windows as their points."""
    points = {"s_sens": "sens", "s_bot": "bot", "s_empty_ref": "empty_ref", "s_dmethod": "dmethod", "s_auth": "c401"}
    wide = windows.trailing_counters(_judged(spark, d), (10, 60))
    return reports.dimension_hits(wide.withColumns({f"{p}_{w}": F.col(f"{c}_{w}") for p, c in points.items() for w in (10, 60)}), (10, 60))


@query
def digest(spark, d):
    return reports.digest(reports.max_score(_judged(spark, d)).select(F.col("source_ip").alias("ip"), "score", "ts"), "suffix")


@query
def distinct_counts(spark, d):
    return reports.distinct_counts(src.access(spark, d))


@query
def set_status(spark, d):
    a = src.access(spark, d)
    return reports.status(a.where("status = 404").select("source_ip").distinct(), _nets(spark), decision.entries(_requests(a)), F.lit(_now(a) + 3000))


@query
def feature_merge(spark, d):
    """The built-in list is what scanners asked for, the cloud's what failed, the local one what succeeded twice."""
    a = src.access(spark, d)
    item = F.col("path").alias("item")
    return features.merge_lists(a.where("source_ip like '%.15'").select(item), a.where("status = 404").select(item), a.where("status = 500").select(item), a.where("path like '/static%'").select(item).distinct())


@query
def feature_caps(spark, d):
    a = src.access(spark, d)
    rows = a.select(F.col("seq").alias("ord"), F.when(F.col("seq") % 3 == 0, "ua").when(F.col("seq") % 3 == 1, "path").otherwise("").alias("category"), F.concat("path", F.col("seq") % 50).alias("value"))
    out = features.capped(features.by_category(rows, most=max(features.OTHER_CAP, *features.FETCHED_CAPS.values())))
    return out.select("category", F.size("items").cast("long").alias("n"), F.array_join(F.slice("items", 1, 5), ",").alias("head"))


@query
def ip_risk_report(spark, d):
    """Flagship: raw lines, parsed, indicators, one-minute counters, the riskiest ten addresses."""
    lines = src.lines(src.access(spark, d))
    e = parsers.nginx(F.col("value"), F.lit(0))
    parsed = lines.select("seq", e.alias("e")).where("e is not null").select("seq", "e.*")
    w = windows.trailing_counters(indicators.indicators(parsed), (60,), ("total", "c404", "c4xx", "sens", "danger", "bot"))
    risk = F.col("sens_60") * 3 + F.col("danger_60") * 5 + F.col("bot_60") + F.col("c4xx_60") + F.col("c404_60")
    top = w.groupBy("source_ip").agg(F.max(risk).alias("risk"), F.max("total_60").alias("peak"), F.count("*").alias("events"))
    return top.orderBy(F.desc("risk"), "source_ip").limit(10)
