"""Per-event indicators (W1) and routing (section 2.4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions import decoding
from ..functions import scalars as S
from ..session import written

#: Distinct values, and their bytes, up to which what depends on a value alone is worked out once and sent to the rows.
FEW_VALUES, FEW_VALUE_BYTES = 100_000, 16 << 20

COUNTERS = (
    "total", "c404", "c401", "c4xx", "c5xx", "auth_fail", "sens", "trav", "danger", "bot", "browser", "empty_ref", "static", "dmethod", "head", "upload",
)


def cleaned(events: DataFrame) -> DataFrame:
    """The events with `path` as F6 leaves it, and `_asked`: the raw path with its query decoded (text), and whether it climbs.

    All that scores a path looks at the cleaned one, so that encoding, parent steps and doubled slashes give one path; only
    danger patterns and climbing look at what was asked for. Events that are cleaned already stay as they are.
    """
    if "_asked" in events.columns:
        return events
    look = events.withColumn("_asked", decoding.looked_at(F.col("path")))
    return look.withColumns({"path": F.col("_asked.path"), "_asked": F.struct("_asked.text", "_asked.traversal")})


def per_value(rows: DataFrame, key: str, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`add` of written rows, which adds columns that depend on the column `key` alone and may change that one: worked out once for each value where these are few, else for each row."""
    values = written(rows.select(key).distinct())
    size = values.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(key)), F.lit(0)).alias("bytes")).first()
    if size["n"] > FEW_VALUES or size["bytes"] > FEW_VALUE_BYTES:
        return add(rows)
    table = written(add(values.withColumn("_key", F.col(key))))
    return rows.withColumnRenamed(key, "_own").join(F.broadcast(table), F.col("_own").eqNullSafe(F.col("_key")), "left").drop("_own", "_key")


def looked_up(events: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Written events as `cleaned` leaves them, with all that `route` and `indicators` ask of a path or an agent alone, and the path's base."""
    path, ua = F.col("path"), F.col("user_agent")
    of_path = {
        "_trap": S.path_list_match(path, cfg.honeypot_paths),
        "_skip": S.path_list_match(path, cfg.skip_paths),
        "_danger": S.contains_any(F.lower("_asked.text"), cfg.patterns),
        "_sens": S.hit_sensitive_path(path, cfg.sensitive_paths),
        "_static": S.is_static_resource(path),
        "_base": S.normalize_404_path(path),
    }
    of_agent = {"_bot": S.is_bot_agent(ua, cfg.known_clients, cfg.bot_agents), "_browser": S.is_browser_agent(ua, cfg.known_clients, cfg.bot_agents, cfg.browser_agents)}
    return per_value(per_value(events, "path", lambda df: cleaned(df).withColumns(of_path)), "user_agent", lambda df: df.withColumns(of_agent))


def route(cfg: DetectorConfig = DetectorConfig(), edge: Column | None = None, clean: bool = False, known: bool = False) -> Column:
    """G1-G4 in the reference order: whitelisted, disabled, loopback (by the client's or the edge's address), honeypot, skipped, scored.

    Paths are matched as F6 leaves them, so that encoding and parent steps neither hide a trap nor reach an open path;
    `clean` says that they are so already, `known` that the events come from `looked_up`.
    """
    ip, path = F.col("source_ip"), F.col("path") if clean or known else decoding.looked_at(F.col("path"))["path"]
    v6 = [w for w in cfg.whitelist if "/" in w and ":" in w]
    white = S.any_of([S.in_cidr(ip, w) if "/" in w else ip == w for w in cfg.whitelist if w not in v6])
    white = white | decoding.in_networks(v6)(ip) if v6 else white
    local = S.is_loopback(ip) if edge is None else S.is_loopback(ip) | F.coalesce(S.is_loopback(edge), F.lit(False))
    return (
        F.when(white, "whitelisted")
        .when(F.lit(not cfg.enabled), "disabled")
        .when(local, "loopback")
        .when(F.col("_trap") if known else S.path_list_match(path, cfg.honeypot_paths), "honeypot")
        .when(F.col("_skip") if known else S.path_list_match(path, cfg.skip_paths), "skipped")
        .otherwise("scored")
    )


def indicators(events: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """The events with the sixteen counters (0 or 1; danger may be more) of W1.

    The path comes out cleaned (F6). Danger patterns are looked up in the fully decoded path with its query (F4), climbing is F5.
    Uses columns body_hits, xxe and upload if there are any. XXE counts twice, as a pattern and as itself.
    """
    events = cleaned(events)
    has = set(events.columns)
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    path, ua, status = F.col("path"), F.col("user_agent"), F.col("status")
    look = lambda name, own: F.col(name) if name in has else own  # noqa: E731  as `looked_up` has it
    danger = look("_danger", S.contains_any(F.lower("_asked.text"), cfg.patterns))
    extra = [F.col(c).cast("long") for c in ("body_hits", "xxe") if c in has]
    danger_n = sum(extra, one(danger) + one(S.is_malformed(F.col("method"), path)))
    auth = (F.col("source") == "linux_auth") & S.is_auth_failure(F.col("auth_action")) if "auth_action" in has else F.lit(False)
    new = {
        "total": F.lit(1).cast("long"),
        "c404": one(status == 404),
        "c401": one(status == 401),
        "c4xx": one(status.between(400, 499) & ~status.isin(404, 499)),
        "c5xx": one(status.between(500, 599)),
        "auth_fail": one(auth),
        "sens": one((status >= 400) & look("_sens", S.hit_sensitive_path(path, cfg.sensitive_paths))),
        "trav": one(F.col("_asked.traversal")),
        "danger": danger_n,
        "bot": one(look("_bot", S.is_bot_agent(ua, cfg.known_clients, cfg.bot_agents))),
        "browser": one(look("_browser", S.is_browser_agent(ua, cfg.known_clients, cfg.bot_agents, cfg.browser_agents))),
        "empty_ref": one(F.col("referer").isin("", "-")),
        "static": one(look("_static", S.is_static_resource(path))),
        "dmethod": one(S.is_dangerous_method(F.col("method"))),
        "head": one(F.upper("method") == "HEAD"),
        "upload": one(F.col("upload")) if "upload" in has else F.lit(0).cast("long"),
    }
    return events.withColumns(new).drop("_asked", "_trap", "_skip", "_danger", "_sens", "_static", "_bot", "_browser")
