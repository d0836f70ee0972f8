"""The detector end to end: routes, counters, the baseline learnt so far, resource enumeration, behaviour, score and block requests (2.4, 2.7, X1, X2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..session import written
from . import baseline, consistency, indicators, scorer, windows
from .confirm import confirm_blocks, idor

RESULT = ("seq", "ts", "source_ip", "source", "path", "status", "route", "best", "final", "is_high", "high_confidence", "honeypot")


def detect(events: DataFrame, cfg: DetectorConfig = DetectorConfig(), resource: tuple[str, str, int] | None = None, preload: baseline.Preload | None = None) -> DataFrame:
    """The columns RESULT of every event that is scored or meets a trap; `seq` must be unique.

    Each window has a baseline of its own, learnt from the first scored event on and looked up as of each event; until it
    is ready, wide defaults hold. `resource` is (path pattern, id pattern, most) of the enumeration check. A trap scores
    twice `high` at once. `preload` judges how far a ready baseline is trusted (B12); without one half-way. Paths are scored, and come out, as F6 cleans them. Behaviour is that of an address's last scored
    events as of each event whose score could be high. No events give no rows.
    """
    edge = F.col("edge_ip") if "edge_ip" in events.columns else None
    asked = {"seq", "ts", "source_ip", "source", "path", "status", "method", "user_agent", "referer", "edge_ip", "auth_action", "body_hits", "xxe", "upload"}
    own = indicators.looked_up(written(events.select(*(c for c in events.columns if c in asked))), cfg)
    routed = own.withColumn("route", indicators.route(cfg, edge, known=True)).where("route in ('scored', 'honeypot')")
    routed = written(indicators.indicators(routed, cfg).drop("user_agent", "referer"))
    own = routed.where("route = 'scored'")
    start = F.lit(own.agg(F.min("ts")).first()[0]).cast("long")
    if resource:
        path, ident, most = resource
        own = own.join(idor(own, path, ident, most=most).select(F.col("seq").alias("_seq"), "idor"), F.col("seq") == F.col("_seq"), "left").drop("_seq")
    else:
        own = own.withColumn("idor", F.lit(0))
    wide = windows.window_counters(windows.ema(own), cfg.windows)
    # Whole panes make up the windows of the snapshots.
    pane = written(windows.panes(own, baseline.TICK)) if all(w % baseline.TICK == 0 for w in cfg.windows) else own
    ticks = {f"base_{w}": written(baseline.baselines(baseline.tick_percentiles(windows.snapshots(pane, w), w), start)) for w in cfg.windows}
    wide = baseline.all_learnt(wide, ticks, start, conf=preload.confidence if preload else baseline.CONFIDENCE, times=own)
    bases = {w: baseline.columns(f"base_{w}") for w in cfg.windows}
    scored = written(scorer.score(wide, bases, cfg, F.col("idor")).withColumn("honeypot", F.lit(False)).select(*RESULT, "method"))
    high = F.coalesce(F.col("final") >= cfg.high, F.lit(False))
    shape = consistency.as_of(scored, keep=cfg.ring, asked=high).select(F.col("seq").alias("_seq"), "is_benign")
    judged = scorer.gated(scored.where(high).join(shape, F.col("seq") == F.col("_seq"), "left"), F.col("is_benign"), cfg)
    scored = scored.where(~high).select(*RESULT).unionByName(judged.select(*RESULT))
    most = F.lit(2 * cfg.high).cast("long")
    traps = routed.where("route = 'honeypot'").withColumns({"best": most, "final": most, "is_high": F.lit(True), "high_confidence": F.lit(True), "honeypot": F.lit(True)})
    return scored.select(*RESULT).unionByName(traps.select(*RESULT))


def blocks(detected: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """The block requests of detected events; none in report-only mode."""
    return confirm_blocks(detected.where(~F.lit(cfg.report_only)), cfg.confirm, cfg.local_ttl)
