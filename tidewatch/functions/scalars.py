"""Scalar functions on columns (F1, F2, F7-F16, F20, F22-F29, F31) and IPv4 predicates (P13, P14). Missing text is ''."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import features


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def contains_any(c: Column, keys: Sequence[str]) -> Column:
    return any_of([c.contains(k) for k in keys])


def without_query(path: Column) -> Column:
    return F.substring_index(path, "?", 1)


def is_variable_segment(s: Column) -> Column:
    """a UUID by shape, digits from four on, or lower-case hex from 24 on."""
    dashes = F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit("")))
    return ((F.length(s) == 36) & (dashes == 4)) | s.rlike("^[0-9]{4,}$") | s.rlike("^[0-9a-f]{24,}$")


def normalize_404_path(path: Column) -> Column:
    """lower-case first four segments with {id} for variable ones."""
    parts = F.filter(F.split(F.lower(F.rtrim(without_query(path), F.lit("/"))), "/"), lambda s: s != "")
    named = F.transform(parts, lambda s: F.when(is_variable_segment(s), F.lit("{id}")).otherwise(s))
    return F.concat(F.lit("/"), F.array_join(F.slice(named, 1, 4), "/"))


def match_patterns(decoded: Column, patterns: Sequence[str] = features.DANGEROUS_PATTERNS) -> Column:
    """F7 on decoded text: the patterns it contains. One pass of a cheap test first, since hits are rare."""
    low = F.lower(decoded)
    listed = F.array(*[F.lit(p) for p in patterns])
    return F.when(contains_any(low, patterns), F.filter(listed, lambda p: low.contains(p))).otherwise(F.array().cast("array<string>"))


def hit_sensitive_path(path: Column, keywords: Sequence[str] = features.SENSITIVE_PATHS) -> Column:
    """F8: keywords with a slash anywhere, others as whole segments; keywords are taken as written."""
    p = F.lower(without_query(path))
    inside = [k for k in keywords if "/" in k]
    whole = [k for k in keywords if "/" not in k]
    return contains_any(p, inside) | F.arrays_overlap(F.split(p, "/"), F.array(*[F.lit(k) for k in whole]))


def is_bot_agent(ua: Column, clients: Sequence[str] = features.KNOWN_CLIENTS, bots: Sequence[str] = features.BOT_AGENTS) -> Column:
    low = F.lower(ua)
    return ~contains_any(low, clients) & contains_any(low, bots)


def is_browser_agent(ua: Column, clients: Sequence[str] = features.KNOWN_CLIENTS, bots: Sequence[str] = features.BOT_AGENTS, browsers: Sequence[str] = features.BROWSER_AGENTS) -> Column:
    low = F.lower(ua)
    safari = low.contains("safari/") & ~low.contains("chrome/")
    trident = low.contains("trident/") & low.contains("rv:")
    return ~ua.isin("", "-") & ~contains_any(low, bots) & ~contains_any(low, clients) & (safari | trident | contains_any(low, browsers))


def is_static_resource(path: Column) -> Column:
    p = F.lower(without_query(path))
    return any_of([p.endswith(x) for x in features.STATIC_EXTENSIONS])


def is_auth_failure(action: Column) -> Column:
    return any_of([action.startswith(x) for x in features.AUTH_FAILURES])


def is_malformed(method: Column, path: Column) -> Column:
    m = F.upper(F.trim(method))
    return ((m != "") & ~m.isin(features.STANDARD_METHODS)) | path.rlike("[\\x00-\\x08\\x0a-\\x1f\\x7f]")


def is_dangerous_method(method: Column) -> Column:
    return F.upper(method).isin(features.DANGEROUS_METHODS)


def path_list_match(path: Column, items: Sequence[str]) -> Column:
    """items that end in / match as prefixes, others as a whole; case does not count."""
    p = F.lower(without_query(path))
    return any_of([p.startswith(i.lower()) if i.endswith("/") else p == i.lower() for i in items])


def upload_blocked(name: Column, mime: Column) -> Column:
    """a blocked extension (also before an image extension) or a blocked MIME type."""
    low = F.lower(F.trim(name))
    ext = any_of([low.endswith(x) for x in features.BLOCKED_EXTENSIONS])
    twice = any_of([low.endswith(b + i) | low.endswith(i + b) for b in features.BLOCKED_EXTENSIONS for i in features.IMAGE_EXTENSIONS])
    return ext | twice | F.lower(F.trim(F.substring_index(mime, ";", 1))).isin(features.BLOCKED_MIMES)


def has_xxe(body: Column) -> Column:
    low = F.lower(body)
    return low.contains("<!doctype") & low.contains("entity")


def first_segment(path: Column) -> Column:
    """the first segment that is not empty, else /."""
    s = F.regexp_extract(without_query(path), "^/*([^/]+)", 1)
    return F.when(s == "", "/").otherwise(s)


def ratio(num: Column, den: Column) -> Column:
    return F.when((num <= 0) | (den <= 0), 0.0).otherwise(num / den)


def deviation(value: Column, p95: Column) -> Column:
    return F.when(p95 <= 0, 0.0).otherwise(F.least(value / p95, F.lit(1000.0)))


def deviation_to_score(dev: Column, threshold: Column) -> Column:
    """0 below the threshold, else ten points a unit above it up to 100, cut to a whole number."""
    return F.when(dev < threshold, 0).otherwise(F.floor(F.least((dev - threshold) * 10, F.lit(100.0)))).cast("long")


def clamp0100(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def method_code(method: Column) -> Column:
    """one letter per method, X for any other."""
    m = F.upper(method)
    return reduce(lambda c, kv: c.when(m == kv[0], kv[1]), [("POST", "P"), ("PUT", "U"), ("DELETE", "D"), ("PATCH", "O"), ("HEAD", "H")], F.when(m == "GET", "G")).otherwise("X")


def uptime(seconds: Column) -> Column:
    """days, hours, minutes and seconds, larger units only if needed."""
    s = seconds.cast("long")
    d, h, m, r = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(d > 0, F.format_string("%dd %dh %dm %ds", d, h, m, r))
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, r))
        .when(m > 0, F.format_string("%dm %ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def ip_number(ip: Column) -> Column:
    """The number of a dotted IPv4 address, null for any other text."""
    p = F.split(ip, "\\.")
    n = reduce(lambda a, k: a * 256 + F.get(p, F.lit(k)).cast("long"), range(1, 4), F.get(p, F.lit(0)).cast("long"))
    good = ip.rlike("^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$")
    return F.when(good, n)


def in_cidr(ip: Column, cidr: str) -> Column:
    """An IPv4 address within a network written as a.b.c.d/n or one address."""
    net, _, bits = cidr.partition("/")
    size = 1 << (32 - int(bits or 32))
    first = sum(int(x) << s for x, s in zip(net.split("."), (24, 16, 8, 0))) // size * size
    return F.coalesce(ip_number(ip).between(first, first + size - 1), F.lit(False))


def is_loopback(ip: Column) -> Column:
    return (ip == "::1") | (ip == "localhost") | in_cidr(ip, "127.0.0.0/8")


def is_private(ip: Column) -> Column:
    """Private, link-local, loopback or unspecified."""
    nets = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "127.0.0.0/8", "0.0.0.0/32"]
    return any_of([in_cidr(ip, n) for n in nets]) | F.lower(ip).rlike("^(::1|::|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")


def to_cidr(ip: Column) -> Column:
    """One address as a network."""
    return F.when(ip.contains("/"), ip).when(ip.contains(":"), F.concat(ip, F.lit("/128"))).otherwise(F.concat(ip, F.lit("/32")))


def bare_ip(cidr: Column) -> Column:
    return F.when(cidr.endswith("/32") | cidr.endswith("/128"), F.substring_index(cidr, "/", 1)).otherwise(cidr)
