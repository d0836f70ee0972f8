"""Reports and rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def report(events: DataFrame, every: int | None = None) -> DataFrame:
    """A1: counts of a whole table or, with `every`, of each period: processed, by score, by status class, distinct addresses."""
    s = F.col("status")
    aggs = [
        F.count("*").alias("processed"), F.count_if(F.col("final") > 0).alias("scored"), F.count_distinct("source_ip").alias("ips"),
        F.count_if("is_high").alias("high"), F.count_if((F.col("final") > 0) & ~F.col("is_high")).alias("medium"), F.count_if(F.col("final") <= 0).alias("low"),
        *[F.count_if(F.floor(s / 100) == k).alias(f"s{k}xx") for k in (2, 3, 4, 5)],
    ]
    if every is None:
        return events.agg(*aggs)
    return events.groupBy((F.floor(F.col("ts") / every) * every).cast("long").alias("period")).agg(*aggs)


def logged(events: DataFrame, low: int = 10) -> DataFrame:
    """The events that statistics and logs see; a threshold of 0 or less stands for 10."""
    return events.where(F.col("final") >= (low if low > 0 else 10))


def logged_report(events: DataFrame, low: int = 10, every: int = 600) -> DataFrame:
    """A1 behind G6: per period all processed events, and of those at least `low` the addresses and score classes."""
    period = (F.floor(F.col("ts") / every) * every).cast("long").alias("period")
    all_of = events.groupBy(period).agg(F.count("*").alias("processed"))
    seen = logged(events, low).groupBy(period).agg(F.count("*").alias("total"), F.count_distinct("source_ip").alias("ips"), F.count_if("is_high").alias("high"), F.count_if(~F.col("is_high")).alias("medium"))
    return all_of.join(seen, "period", "left").na.fill(0, ["total", "ips", "high", "medium"])


#: A1: the dimensions of a report and the part of a window's score that each is a hit of.
HITS = {"sensitive_path": "s_sens", "bot_ua": "s_bot", "empty_referer": "s_empty_ref", "dangerous_method": "s_dmethod", "auth_fail": "s_auth"}
SOURCES = {"nginx": "nginx_access", "apache": "apache_access", "tomcat": "tomcat_access", "linux": "linux_auth"}


def dimension_hits(scored: DataFrame, windows: Sequence[int] = (10, 30, 60), low: int = 10, every: int = 600) -> DataFrame:
    """A1 behind G6: per period the events at least `low`, how many come from each kind of source, and how many hit each dimension.

    An event hits a dimension if some window's score has points for it. Periods without such events give no row.
    """
    hit = lambda part: F.count_if(S.any_of([F.col(f"{part}_{w}") > 0 for w in windows]))
    period = (F.floor(F.col("ts") / every) * every).cast("long").alias("period")
    from_ = [F.count_if(F.col("source") == v).alias(f"from_{k}") for k, v in SOURCES.items()]
    return logged(scored, low).groupBy(period).agg(F.count("*").alias("total"), *from_, *[hit(part).alias(f"{n}_hits") for n, part in HITS.items()])


def per_source(events: DataFrame) -> DataFrame:
    """A1 by source and status class, with subtotals."""
    return events.rollup("source", F.floor(F.col("status") / 100).alias("status_class")).agg(F.count("*").alias("n"))


def blocked_rollup(hits: DataFrame) -> DataFrame:
    """A2: per address count, greatest score, last time by arrival, distinct sources."""
    return hits.groupBy("source_ip").agg(F.count("*").alias("n"), F.max("final").alias("max_score"), F.max_by("ts", "seq").alias("last_ts"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def top_blocked(hits: DataFrame, k: int = 10) -> DataFrame:
    """A3: the k most blocked addresses; ties by address."""
    return blocked_rollup(hits).orderBy(F.desc("n"), "source_ip").limit(k)


def sampled(events: DataFrame, every: int, keep: int = 1000) -> DataFrame:
    """A4: one event in `every` by arrival, the last `keep` of them. `seq` counts arrivals."""
    return events.where(F.col("seq") % every == 0).orderBy(F.desc("seq")).limit(keep)


def max_score(events: DataFrame) -> DataFrame:
    """A5: the event of greatest score of each address; the first wins ties."""
    best = F.max(F.struct("final", (-F.col("seq")).alias("_s"), "ts", "path")).alias("x")
    return events.groupBy("source_ip").agg(best).select("source_ip", F.col("x.final").alias("score"), (-F.col("x._s")).alias("seq"), F.col("x.ts").alias("ts"), F.col("x.path").alias("path"))


def _values(events: DataFrame, *keep: Column | str) -> DataFrame:
    """The columns kept, dim and value of each event's four dimensions."""
    dims = {"path": F.col("path"), "user_agent": F.col("user_agent"), "method": F.col("method"), "status": F.col("status").cast("string")}
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), v.alias("value")) for d, v in dims.items()])).alias("x")
    return events.select(*keep, each).select("*", "x.dim", "x.value").drop("x")


def feature_stats(events: DataFrame, k: int = 20) -> DataFrame:
    """Per dimension the k commonest values with hits and how many of them scored high and low."""
    rows = _values(events, "is_high").groupBy("dim", "value").agg(F.count("*").alias("hits"), F.count_if("is_high").alias("high"), F.count_if(~F.col("is_high")).alias("low"))
    w = Window.partitionBy("dim").orderBy(F.desc("hits"), "value")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def feature_sketches(events: DataFrame, every: int = 600, tracked: int = 10_000) -> DataFrame:
    """A6 that can be added up: per period and dimension a frequent-items sketch (period, dim, sketch).

    Sketches are made where the rows lie and merged by shuffle, so a period moves one of at most `tracked` values a
    partition, however many values there are.
    """
    return (
        _values(events, (F.floor(F.col("ts") / every) * every).cast("long").alias("period"))
        .groupBy("period", "dim").agg(F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("sketch"))
    )


def sketched_stats(sketches: DataFrame, k: int = 20, tracked: int = 10_000) -> DataFrame:
    """The k commonest values of each dimension over all periods given: dim, value, hits, rank.

    With up to 3/4 of `tracked` distinct values hits are exact; beyond, a value with more than 3.5 / tracked of all hits is
    never missed and its hits are off by at most that share.
    """
    found = sketches.groupBy("dim").agg(F.expr("approx_top_k_combine(sketch)").alias("s"))
    each = F.explode(F.expr(f"approx_top_k_estimate(s, {tracked})")).alias("x")
    rows = found.select("dim", each).select("dim", F.col("x.item").alias("value"), F.col("x.count").alias("hits"))
    w = Window.partitionBy("dim").orderBy(F.desc("hits"), "value")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def score_range(decisions: DataFrame) -> DataFrame:
    """A8."""
    return decisions.agg(F.min("final_score").alias("least"), F.max("final_score").alias("most"))


def status(blocked: DataFrame, white: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Sizes of the sets and of what has not expired."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(blocked, "blocked").join(one(white, "whitelisted"), F.lit(True)).join(one(entries.where(F.col("expires_at") > now), "with_ttl"), F.lit(True))


def distinct_counts(events: DataFrame, exact: bool = True) -> DataFrame:
    """A10: distinct addresses, paths and agents; approximate ones need no second shuffle."""
    n = F.count_distinct if exact else F.approx_count_distinct
    return events.agg(*[n(c).alias(f"n_{c}") for c in ("source_ip", "path", "user_agent")])


def digest(payload: DataFrame, suffix: str = "") -> DataFrame:
    """sha256 of ip|score|ts of a payload's rows in order of ip and ts. One payload is one report, so its rows are few."""
    row = F.struct("ip", "ts", F.concat_ws("|", "ip", F.col("score").cast("string"), F.col("ts").cast("string")).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["s"]), ";")
    return payload.agg(F.sha2(F.concat(text, F.lit(suffix)), 256).alias("digest"))


def detail(scored: DataFrame, window: int = 60) -> DataFrame:
    """A line of text for each scored event."""
    return scored.select("seq", F.format_string("ip=%s path=%s status=%d score=%d freq=%d dims=%d high=%s", "source_ip", "path", "status", "final", "freq", f"dims_{window}", F.col("is_high").cast("string")).alias("detail"))
