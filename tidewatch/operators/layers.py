"""Threat scores in two layers (X12): what all tenants share and what is a tenant's own, each from a snapshot or from steps after a cursor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decision import cover, decide_all


@dataclass(frozen=True)
class Cursor:
    """How far an agent has come: the name of its shared snapshot, and the last step of each layer."""

    base: str = ""
    shared: int = 0
    own: int = 0


@dataclass(frozen=True)
class Server:
    """The present name of the shared snapshot, and whether the tenant's own layer must be taken whole."""

    base: str
    own_whole: bool = False


def due(feed: DataFrame, at: Cursor, server: Server) -> DataFrame:
    """The rows of a feed (layer global or tenant, whole, seq, ip, ...) that an agent at this cursor takes.

    A layer whose snapshot is needed gives that and the steps after it; otherwise the steps after the cursor.
    """
    need = F.when(F.col("layer") == "global", F.lit(at.base != server.base)).otherwise(F.lit(server.own_whole))
    since = F.when(F.col("layer") == "global", at.shared).otherwise(at.own)
    bases = feed.where("whole").groupBy(F.col("layer").alias("_l")).agg(F.max("seq").alias("_base"))  # a row a layer
    rows = feed.join(F.broadcast(bases), F.col("layer") == F.col("_l"), "left").withColumn("_base", F.coalesce("_base", F.lit(-1).cast("long")))
    return rows.where(F.when(need, (F.col("whole") & (F.col("seq") == F.col("_base"))) | (~F.col("whole") & (F.col("seq") > F.col("_base")))).otherwise(~F.col("whole") & (F.col("seq") > since))).drop("_l", "_base")


def scores(feed: DataFrame, at: Cursor, server: Server) -> DataFrame:
    """ip, layer, score, vote_count, source: the last due row of each address, the tenant's own over the shared one."""
    rank = F.struct((F.col("layer") == "tenant").alias("own"), "seq", (~F.col("whole")).alias("step"))
    last = due(feed, at, server).groupBy("ip").agg(F.max_by(F.struct("layer", "score", "vote_count", "source"), rank).alias("x"))
    return last.select("ip", "x.*")


def applied(feed: DataFrame, allowed: DataFrame, local: DataFrame, now: Column, at: Cursor, server: Server) -> DataFrame:
    """ip, layer, cloud_score, final_score, action of every address that the two layers or the allow list name.

    Scores are decided with the local ones (X10). Rows of the tenant's allow list (seq, ip or network, op) after its cursor
    pass without a decision, as white_add or white_del; a block that an allowed address or network covers comes out as `filtered`.
    """
    own = scores(feed, at, server)
    decided = decide_all(own.drop("layer"), local, now).join(own.select("ip", "layer"), "ip")
    last = allowed.where(F.lit(server.own_whole) | (F.col("seq") > at.own)).groupBy("ip").agg(F.max_by("op", "seq").alias("op"))
    free = cover(decided.select("ip").distinct(), last.where("op = 'add'").select(F.col("ip").alias("net"))).withColumn("_free", F.lit(True))
    action = F.when((F.col("action") == "block") & F.col("_free"), "filtered").otherwise(F.col("action"))
    out = decided.join(free, "ip", "left").select("ip", "layer", "cloud_score", "final_score", action.alias("action"))
    none = F.lit(None).cast("double")
    return out.unionByName(last.select("ip", F.lit("tenant").alias("layer"), none.alias("cloud_score"), none.alias("final_score"), F.concat(F.lit("white_"), "op").alias("action")))


def moved(feed: DataFrame, at: Cursor, server: Server) -> DataFrame:
    """base, shared, own: the cursor after the due rows are taken; it never goes back."""
    top = lambda name, least: F.greatest(F.lit(least), F.coalesce(F.max(F.when(F.col("layer") == name, F.col("seq"))), F.lit(least))).cast("long")
    return due(feed, at, server).agg(F.lit(server.base).alias("base"), top("global", at.shared).alias("shared"), top("tenant", at.own).alias("own"))
