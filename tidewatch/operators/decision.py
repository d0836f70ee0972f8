"""Decisions on threat intelligence and the state of the block and allow lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decoding
from ..functions import scalars as S

CLOUD_TTL, LOCAL_TTL = 7200, 3600


def confidence(votes: Column, source: Column) -> Column:
    """How far a threat score counts; two votes count like none."""
    by_votes = F.when(votes >= 20, 1.0).when(votes >= 10, 0.9).when(votes >= 5, 0.75).when(votes >= 3, 0.6).when(votes == 1, 0.4).otherwise(0.7)
    return F.when((source != "global") | (votes <= 0), 0.7).otherwise(by_votes)


def decide(intel: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """The composite decision of rows (ip, score, vote_count, source, local_freq, detector)."""
    cloud, freq, det = (S.clamp0100(F.col(c).cast("double")) for c in ("score", "local_freq", "detector"))
    conf = confidence(F.col("vote_count"), F.col("source"))
    rows = intel.select("ip", cloud.alias("cloud_score"), "vote_count", conf.alias("cloud_confidence"), freq.alias("local_freq"), det.alias("detector"), "source")
    fast = (F.col("source") == "global") & (F.col("vote_count") >= 20) & (F.col("cloud_score") >= 90)
    eff = F.col("cloud_score") * F.col("cloud_confidence")
    final = F.when(fast, 80.0).otherwise(F.round(eff * weights[0] + F.col("local_freq") * weights[1] + F.col("detector") * weights[2], 6))
    out = rows.withColumns({"fast_path": fast, "effective_cloud": eff, "final_score": final})
    action = F.when(F.col("final_score") >= 80, "block").when(F.col("final_score") >= 50, "alert").otherwise("ignore")
    return out.withColumn("action", action).drop("source")


def decide_all(intel: DataFrame, local: DataFrame, now: Column, recent: int = 60) -> DataFrame:
    """Intel joined to local scores (ip, freq, detector, last_seen); unknown or stale addresses count 50 and 50."""
    l = local.where(F.col("last_seen") >= now - recent).select("ip", F.col("freq").alias("local_freq"), "detector")
    both = intel.join(l, "ip", "left").withColumns({"local_freq": F.coalesce(F.col("local_freq").cast("double"), F.lit(50.0)), "detector": F.coalesce(F.col("detector").cast("double"), F.lit(50.0))})
    return decide(both)


def ttl(seconds: Column, source: Column, local: int = LOCAL_TTL, cloud: int = CLOUD_TTL) -> Column:
    """Local 3600 unless given; cloud 7200 unless given, and never more."""
    shared = F.when(seconds <= 0, cloud).otherwise(F.least(seconds, F.lit(cloud)))
    return F.when(source == "cloud", shared).otherwise(F.when(seconds <= 0, local).otherwise(seconds)).cast("long")


def entries(requests: DataFrame) -> DataFrame:
    """The entry of each address after its last request (ord, ip, source, ttl, at): ip, source, ttl, expires_at."""
    last = F.max(F.struct("ord", "source", "ttl", "at")).alias("x")
    x = requests.where("ip != ''").groupBy("ip").agg(last).select("ip", F.col("x.source").alias("source"), ttl(F.col("x.ttl"), F.col("x.source")).alias("ttl"), F.col("x.at").alias("at"))
    return x.select("ip", "source", "ttl", (F.col("at") + F.col("ttl")).alias("expires_at"))


def active(state: DataFrame, now: Column) -> DataFrame:
    """What a sweep or a restore keeps."""
    return state.where((F.col("expires_at") > now) & (F.col("ip") != ""))


def valid_address(ip: Column) -> Column:
    """P15 for columns: an IPv4 or IPv6 address or network. Only texts that look like IPv6 go to Python."""
    host, bits = F.substring_index(ip, "/", 1), F.when(ip.contains("/"), F.substring_index(ip, "/", -1))
    v4 = S.ip_number(host).isNotNull() & (bits.isNull() | bits.rlike("^([0-9]|[12][0-9]|3[0-2])$"))
    shaped = host.rlike("^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$")
    v6 = shaped & decoding.ipv6_bits(F.when(shaped, host)).isNotNull() & (bits.isNull() | bits.rlike("^([0-9]{1,2}|1[01][0-9]|12[0-8])$"))
    return v4 | v6


def spelling(ip: Column) -> Column:
    """One text for all spellings of an IPv6 address (its bits); other texts as they are."""
    v6 = ip.contains(":")
    return F.when(v6, F.coalesce(decoding.ipv6_bits(F.when(v6, ip)), ip)).otherwise(ip)


def cover(ips: DataFrame, nets: DataFrame, key: str = "ip") -> DataFrame:
    """Rows of `ips` that one of `nets` (column net: an address, or an IPv4 or IPv6 network) covers.

    Networks become an equal join on their prefix: an address has one prefix for each prefix length
    that the networks use, at most 33 and 129, so no range is compared with every address. A single IPv6 address
    is a network of 128 bits, so its spelling does not matter.
    """
    bits = F.when(F.col("net").contains("/"), F.substring_index("net", "/", -1).try_cast("int")).when(F.col("net").contains(":"), 128).otherwise(32)
    n = nets.select(S.ip_number(F.substring_index("net", "/", 1)).alias("first"), bits.alias("bits")).where("first is not null")
    v4 = n.select("bits", F.floor(F.col("first") / F.pow(F.lit(2.0), 32 - F.col("bits"))).cast("long").alias("prefix")).distinct()
    exact = nets.select(F.col("net").alias(key)).distinct()
    lengths = v4.agg(F.collect_set("bits").alias("all_bits"))
    num = ips.withColumn("_n", S.ip_number(F.col(key)))
    each = num.where("_n is not null").join(F.broadcast(lengths), F.lit(True)).withColumn("_b", F.explode("all_bits")).drop("all_bits")
    each = each.withColumn("_p", F.floor(F.col("_n") / F.pow(F.lit(2.0), 32 - F.col("_b"))).cast("long"))
    hit = each.join(v4, (F.col("_b") == F.col("bits")) & (F.col("_p") == F.col("prefix")), "left_semi").select(key)
    v6 = nets.where(F.col("net").contains(":")).select(decoding.ipv6_bits(F.substring_index("net", "/", 1)).alias("all"), bits.alias("bits"))
    v6 = v6.where("all is not null and bits <= 128").select("bits", F.expr("left(all, bits)").alias("prefix")).distinct()
    wide = ips.where(F.col(key).contains(":")).select(key, decoding.ipv6_bits(F.col(key)).alias("_all")).where("_all is not null")
    wide = wide.join(F.broadcast(v6.agg(F.collect_set("bits").alias("all_bits"))), F.lit(True)).withColumn("_b", F.explode("all_bits")).withColumn("_p", F.expr("left(_all, _b)"))
    hit = hit.unionByName(wide.join(v6, (F.col("_b") == F.col("bits")) & (F.col("_p") == F.col("prefix")), "left_semi").select(key))
    return ips.join(hit.unionByName(ips.join(exact, key, "left_semi").select(key)).distinct(), key, "left_semi")


def block(requests: DataFrame, whitelist: DataFrame, blocked: DataFrame) -> DataFrame:
    """Ip, outcome (invalid, whitelisted, exists, blocked) of block requests (ip, force)."""
    covered = cover(requests.select("ip").distinct(), whitelist).withColumn("_w", F.lit(True))
    known = blocked.select(spelling(F.col("ip")).alias("_s")).distinct().withColumn("_k", F.lit(True))
    both = requests.join(covered, "ip", "left").withColumn("_s", spelling(F.col("ip"))).join(known, "_s", "left")
    out = F.when(~valid_address(F.col("ip")), "invalid").when(F.col("_w") & ~F.col("force"), "whitelisted").when(F.col("_k"), "exists").otherwise("blocked")
    return both.select("ip", out.alias("outcome"))


def unblock(requests: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state without the requested addresses, and the outcome of each request."""
    asked, held = (x.withColumn("_s", spelling(F.col("ip"))) for x in (requests, blocked))
    known = held.select("_s").distinct().withColumn("_k", F.lit(True))
    outcome = asked.join(known, "_s", "left").select("ip", F.when(F.col("_k"), "unblocked").otherwise("not blocked").alias("outcome"))
    return held.join(asked.select("_s"), "_s", "left_anti").select(*blocked.columns), outcome


def cloud_apply(changes: DataFrame, local_white: DataFrame) -> DataFrame:
    """Set, ip, op of the last change of each (set, ip) from rows (ord, set, ip, op), allow list first.

    Invalid addresses go; blacklist entries on the local allow list come out as op `filtered`; an address
    that the allow list gains leaves the blacklist.
    """
    ok = changes.where(valid_address(F.col("ip")))
    last = ok.groupBy("set", "ip").agg(F.max_by("op", "ord").alias("op"))
    gained = last.where("set = 'white' and op = 'add'").select("ip").withColumn("_g", F.lit(True))
    white = cover(last.select("ip").distinct(), local_white).withColumn("_w", F.lit(True))
    black = last.where("set = 'black'").join(white, "ip", "left").join(gained, "ip", "full_outer")
    op = F.when(F.col("_g"), "del").when(F.col("_w") & (F.col("op") == "add"), "filtered").otherwise(F.col("op"))
    return last.where("set = 'white'").unionByName(black.select(F.lit("black").alias("set"), "ip", op.alias("op")))


def whitelist_sync(old: DataFrame, desired: DataFrame, blocked: DataFrame) -> DataFrame:
    """Net, op: every desired network is added, old ones that are not desired are deleted, covered blocked addresses are unblocked."""
    add = desired.select("net").distinct().withColumn("op", F.lit("add"))
    gone = old.select("net").exceptAll(desired.select("net")).distinct().withColumn("op", F.lit("del"))
    free = cover(blocked.select("ip").distinct(), desired).select(F.col("ip").alias("net"), F.lit("unblock").alias("op"))
    return add.unionByName(gone).unionByName(free)


def apply_diff(base: DataFrame, increments: DataFrame, after: int, need_base: bool) -> DataFrame:
    """Ip, score from the snapshot (if the cursor is too old) and the increments (seq, op, ip, score) after the cursor; the last op wins."""
    new = increments.where(F.col("seq") > after).select("ip", "seq", "op", "score")
    start = base.select("ip", F.lit(-1).cast("long").alias("seq"), F.lit("add").alias("op"), "score")
    rows = start.unionByName(new) if need_base else new
    last = rows.groupBy("ip").agg(F.max(F.struct("seq", "op", "score")).alias("x"))
    return last.where("x.op = 'add'").select("ip", F.col("x.score").alias("score"))


def set_state(log: DataFrame) -> DataFrame:
    """S12, Section 2.14: the members after a change log (ord, set, ip, op, timeout)."""
    w = Window.partitionBy("set", "ip").orderBy(F.desc("ord"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1 and op = 'add'").drop("_n", "op", "ord")
