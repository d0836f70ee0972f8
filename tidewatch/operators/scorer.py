"""Scores per event and window (K1-K8), as column expressions in the order of the scoring steps."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions import decoding
from ..functions import scalars as S
from .baseline import DIMS, Preload, guard_qps, sensitivity, thresholds
from .indicators import COUNTERS

RELATIVE = ("qps", "r4xx", "r5xx", "auth", "r404", "sens", "bot", "empty_ref", "head")
COUNT_OF = {"r4xx": "c4xx", "r5xx": "c5xx", "r404": "c404", "auth": "auth_fail", "sens": "sens", "bot": "bot", "empty_ref": "empty_ref", "head": "head"}


def literals(p: Preload) -> dict[str, Column]:
    """The preload's baseline as columns {dim_p50, dim_p95, dim_n, conf}."""
    out = {"conf": F.lit(float(p.confidence))}
    for d in DIMS:
        p50, p95, _, n = p.dims.get(d, (0.0, 0.0, 0.0, 0))
        out |= {f"{d}_p50": F.lit(float(p50)), f"{d}_p95": F.lit(float(p95)), f"{d}_n": F.lit(int(n))}
    return out


def score_window(df: DataFrame, w: int, base: Mapping[str, Column], cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Add score_W and its parts for one window of a table of window counters with `seen` and `ema`."""
    high, med, cap = cfg.high, cfg.medium, cfg.high * 6 // 10
    c = lambda n: F.col(f"{n}_{w}")
    v = lambda n: F.col(f"_{n}")
    learnt = lambda n: base.get(f"own_{n}", base[n])
    total = c("total")
    cut = lambda x: F.floor(x).cast("long")
    sens = sensitivity(F.col("seen"), cfg.sensitivity)
    df = df.withColumns({"_s": sens, "_th": F.element_at(thresholds(learnt("qps_p50"), learnt("qps_p95"), learnt("qps_n"), learnt("conf")), sens), "_qps": total / F.lit(float(w))})
    # Deviations.
    qdev = S.deviation(v("qps"), base["qps_p95"])
    own = F.when((F.col("seen") > 20) & (F.col("ema") > 0), v("qps") / F.col("ema"))
    devs = {"_dev_qps": F.when(own > qdev, own).otherwise(qdev)}
    devs |= {f"_dev_{d}": S.deviation(S.ratio(c(n), total), base[f"{d}_p95"]) for d, n in COUNT_OF.items()}
    df = df.withColumns(devs)
    raw = {f"_raw_{d}": F.when(total >= 5, S.deviation_to_score(v(f"dev_{d}"), v("th"))).otherwise(0).cast("long") for d in RELATIVE}
    df = df.withColumns(raw)
    calm = (c("danger") + c("bot") + c("trav") + c("dmethod") + c("upload")) == 0
    q = v("raw_qps")
    df = df.withColumns({
        "_raw_qps": F.when(base["conf"] < 0.3, cut(q * 5 / 10)).when(calm, cut(q * 3 / 10)).otherwise(q),
        "_danger": F.least(c("danger") * cfg.weights.pattern, F.lit(high // 2)).cast("long"),
        "_trav": F.least(c("trav") * cfg.weights.pattern, F.lit(high // 2)).cast("long"),
        "_dmethod": F.least(c("dmethod") * cfg.weights.method, F.lit(9)).cast("long"),
        "_upload": F.least(c("upload") * cfg.weights.upload, F.lit(high)).cast("long"),
    })
    # Bonus and the legitimate-user context.
    share = S.ratio(c("browser"), total)
    page = (share >= 0.95) & (c("bot") == 0) & (c("static") > 0)
    bonus = c("static") * 3 + total - c("empty_ref") + F.when(page, cut(c("c404") * 0.5)).otherwise(0)
    fatal = (c("danger") + c("dmethod") + c("upload") + c("trav")) > 0
    few = lambda n, part, most: (S.ratio(c(n), total) <= part) & (c(n) <= most)
    noise = F.when(share >= 0.95, few("bot", 0.03, 5) & few("sens", 0.02, 3) & few("auth_fail", 0.02, 3)).otherwise((c("bot") + c("sens") + c("auth_fail")) == 0)
    limit = F.element_at(F.array(F.lit(40.0), F.lit(100.0), F.lit(200.0)), v("s"))
    legit = (c("browser") > 0) & (total >= 3) & ~fatal & noise & (v("dev_qps") < limit) & (v("dev_r4xx") < limit) & (v("dev_r404") < limit)
    conc = c("d4xx").between(1, 2) & (c("browser") == 0) & (c("bot") == 0) & ((v("raw_r4xx") > 0) | (v("dev_r4xx") >= 1))
    df = df.withColumns({"_bonus": bonus, "_legit": legit, "_conc": conc})
    s4 = F.when(v("legit"), cut(v("raw_r4xx") / 10)).otherwise(v("raw_r4xx"))
    s4 = F.when(v("conc"), cut(s4 * 5 / 10)).otherwise(s4)
    capped = {f"_rel_{d}": F.least(v(f"raw_{d}"), F.lit(cap)).cast("long") for d in ("qps", "r5xx", "auth", "sens", "bot", "head")}
    capped |= {"_rel_r4xx": F.least(s4, F.lit(cap)).cast("long"), "_rel_r404": F.least(F.when(v("legit"), cut(v("raw_r404") / 10)).otherwise(v("raw_r404")), F.lit(cap)).cast("long")}
    # Empty referer counts in full only beside another signal.
    proof = S.any_of([v(f"dev_{d}") >= v("th") for d in ("qps", "r4xx", "r404", "r5xx", "auth", "sens", "bot")]) | (v("danger") > 0) | (v("dmethod") > 0)
    many404 = (total >= 5) & (c("c404") > 0) & (cut(c("c404") * 100 / total) >= 50)
    points = F.when(proof, v("raw_empty_ref")).otherwise(cut(v("raw_empty_ref") / 5))
    capped["_rel_empty_ref"] = F.least(points, F.when(many404, high // 2).otherwise(high // 4), F.lit(cap)).cast("long")
    df = df.withColumns(capped)
    idle = v("qps") < guard_qps(learnt("qps_p95"), learnt("qps_n"))
    df = df.withColumn("_idle", idle).withColumns({f"_rel_{d}": F.when(v("idle"), 0).otherwise(v(f"rel_{d}")).cast("long") for d in RELATIVE})
    dims = reduce(lambda a, d: a + F.when(v(f"rel_{d}") > 0, 1).otherwise(0), RELATIVE, F.lit(0))
    df = df.withColumns({"_dims": dims, "_rel": reduce(lambda a, d: a + v(f"rel_{d}"), RELATIVE, F.lit(0)), "_abs": v("danger") + v("dmethod") + v("upload") + v("trav")})
    rel = F.when((v("dims") <= 1) & (v("abs") == 0), F.least(v("rel"), F.lit(med))).otherwise(v("rel"))
    gift = F.when(v("legit") & (v("bonus") > 0), cut(v("bonus") * 15 / 10)).otherwise(v("bonus"))
    df = df.withColumn("_sc", rel + v("abs") - gift)
    score = F.when(v("idle") & (v("abs") < med), F.least(v("sc"), F.lit(med))).otherwise(v("sc"))
    # Scanner agents on several sensitive paths lift those two parts after the total was taken.
    synergy = (c("bot") > 0) & (c("sens") >= 3)
    least = cap * 60 // 100
    lifted = lambda d: F.when(synergy, F.greatest(v(f"rel_{d}"), F.lit(least))).otherwise(v(f"rel_{d}"))
    df = df.withColumns({"_rel_bot": lifted("bot"), "_rel_sens": lifted("sens")})
    parts = {"freq": reduce(lambda a, d: a + v(f"rel_{d}"), RELATIVE, F.lit(0)).cast("long"), "dims": v("dims").cast("long"), "legit": v("legit"), "inactive": v("idle"), "s_danger": v("danger"), "s_dmethod": v("dmethod"), "s_upload": v("upload"), "s_bot": v("rel_bot").cast("long"), "s_sens": v("rel_sens").cast("long"), "s_auth": v("rel_auth"), "s_empty_ref": v("rel_empty_ref")}
    df = df.withColumns({f"score_{w}": score.cast("long")} | {f"{n}_{w}": x for n, x in parts.items()})
    return df.drop(*[x for x in df.columns if x.startswith("_")])


def _best(df: DataFrame, base: Mapping, cfg: DetectorConfig) -> DataFrame:
    """K1: add the window scores and `best`, which stays under `high` if no window's baseline can be trusted."""
    of = lambda w: base.get(w, base)
    for w in cfg.windows:
        df = score_window(df, w, of(w), cfg)
    top = F.least(F.greatest(F.lit(0), *[F.col(f"score_{w}") for w in cfg.windows]), F.lit(2 * cfg.high))
    trust = S.any_of([of(w).get("own_conf", of(w)["conf"]) >= 0.1 for w in cfg.windows])
    return df.withColumn("best", F.when((top >= cfg.high) & ~trust, cfg.high - 1).otherwise(top).cast("long"))


def score(df: DataFrame, base: Mapping, cfg: DetectorConfig = DetectorConfig(), idor: Column | None = None, benign: Column | None = None) -> DataFrame:
    """K1-K6: best, final, is_high, high_confidence, freq and detect of every event.

    `base` is one baseline for all windows or a baseline for each (see `literals` and `baseline.columns`).
    """
    df = _best(df, base, cfg)
    each = lambda n: [F.col(f"{n}_{w}") for w in cfg.windows]
    final = F.least(F.lit(cfg.high), F.col("best") + (F.coalesce(idor, F.lit(0)) if idor is not None else F.lit(0)))
    sure = S.any_of([(F.col(f"danger_{w}") >= 2) | (F.col(f"s_dmethod_{w}") > 0) | (F.col(f"s_upload_{w}") > 0) | ((F.col(f"s_bot_{w}") > 0) & ~F.col(f"legit_{w}")) for w in cfg.windows])
    df = df.withColumns({
        "final": final.cast("long"), "is_high": final >= cfg.high, "high_confidence": sure,
        "freq": F.least(F.greatest(*each("freq")), F.lit(cfg.high)).cast("long"), "detect": F.col("best"),
    })
    return df if benign is None else gated(df, benign, cfg)


def gated(df: DataFrame, benign: Column, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """High scores of events whose address behaves well fall to medium, but for trusted IPv4 and IPv6 networks."""
    trusted = decoding.in_networks(cfg.trusted_subnets)(F.col("source_ip")) if any(":" in n for n in cfg.trusted_subnets) else S.any_of([S.in_cidr(F.col("source_ip"), n) for n in cfg.trusted_subnets])
    final = F.when((F.col("final") >= cfg.high) & F.coalesce(benign, F.lit(False)) & ~trusted, cfg.medium).otherwise(F.col("final"))
    return df.withColumns({"final": final.cast("long"), "is_high": final >= cfg.high})


def recent_scores(events: DataFrame, now: Column, base: Mapping, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """K8: source_ip, score of every address that is not idle at `now`, over its plain counters (no distinct bases).

    `events` have the counters of W1, `seen` and `ema`; of an address's last event these two count.
    """
    past = events.where(F.col("ts") <= now)
    within = lambda w, c: F.coalesce(F.sum(F.when(F.col("ts") > now - w, F.col(c))), F.lit(0))
    sums = {f"{c}_{w}": within(w, c) for w in cfg.windows for c in COUNTERS}
    last = F.max_by(F.struct("seen", "ema"), F.struct("ts", "seq")).alias("x")
    own = past.groupBy("source_ip").agg(F.max("ts").alias("last"), last, *[c.alias(n) for n, c in sums.items()]).where(now - F.col("last") < cfg.idle)
    wide = own.select("source_ip", "x.seen", "x.ema", *sums, *[F.lit(0).cast("long").alias(f"d4xx_{w}") for w in cfg.windows])
    return _best(wide, base, cfg).select("source_ip", F.col("best").alias("score"))


def local_scores(scored: DataFrame) -> DataFrame:
    """K6, K7: per address the frequency and detector scores at its last event, and when that was."""
    last = F.max(F.struct("ts", "seq", "freq", "detect")).alias("x")
    return scored.groupBy("source_ip").agg(last).select(F.col("source_ip").alias("ip"), F.col("x.freq").alias("freq"), F.col("x.detect").alias("detector"), F.col("x.ts").alias("last_seen"))
