"""Log-line parsers as column expressions (P1-P12). A parser maps a text column to a struct and a flag that it matched."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line formats.
CLF = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([^"]*)"(?:\s+(\d{3})(?:\s+(\d+|-))?(?:\s+"([^"]*)"\s+"([^"]*)")?)?'
EXTENDED = r'^(\S+)\s+\d+\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([^"]*)"(?:\s+(\d{3})(?:\s+(\d+|-))?(?:\s+"([^"]*)"\s+"([^"]*)"(?:\s+"([^"]*)"(?:\s+"([^"]*)"(?:\s+"([^"]*)")?)?)?)?)?'
TOMCAT = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})\s+(\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?'
AUTH = r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[\d+\])?:\s+(.*)$"
AUTH_IP = r"from\s+(\d{1,3}(?:\.\d{1,3}){3}|[0-9a-fA-F:]+)\s+port\s+\d+"
AUTH_USER = r"for\s+(?:invalid user\s+)?(\S+)"
PORT_SOURCE, PORT_TARGET = r"\bSRC=(\S+)", r"\bDPT=(\d+)"


def undash(c: Column) -> Column:
    return F.when(F.trim(c) == "-", "").otherwise(c)


def request_part(request: Column, k: int) -> Column:
    """P10: method (0) or path (1) of a request line; both empty unless it has two parts."""
    parts = F.split(F.trim(request), " ", 3)
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(k))).otherwise("")


def number(c: Column, kind: str) -> Column:
    return F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))


def access_time(t: Column, fallback: Column) -> Column:
    """Unix seconds; `fallback` where the time does not parse."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(t, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))), fallback).cast("long")


def real_ip(remote: Column, xff: Column, cf: Column, tcip: Column) -> tuple[Column, Column]:
    """The client's address and which header it came from."""
    has = lambda c: (c != "") & (c != "-")
    cf, tcip, xff = F.trim(cf), F.trim(tcip), F.trim(F.substring_index(F.trim(xff), ",", 1))
    ip = F.when(has(cf), cf).when(has(tcip), tcip).when(has(xff), xff).otherwise(remote)
    how = F.when(has(cf), "cf_connecting_ip").when(has(tcip), "true_client_ip").when(has(xff), "xff").otherwise("direct")
    return ip, how


def _event(source: str, line: Column, ok: Column, **known: Column) -> Column:
    """EVENT struct with every column; what a parser does not know is empty."""
    text, zero = F.lit(""), F.lit(0)
    base = {
        "ts": zero.cast("long"), "ts_parse_ok": F.lit(False), "source_ip": text, "source": F.lit(source), "raw_line": line, "method": text, "path": text,
        "status": zero.cast("int"), "bytes_sent": zero.cast("long"), "user_agent": text, "referer": text, "auth_action": text, "auth_user": text,
        "local_risk_score": zero.cast("int"), "body": text, "content_type": text, "file_name": text, "file_ext": text, "file_mime": text,
        "edge_ip": text, "client_ip_from": text, "truncated": F.lit(False),
    }
    return F.when(ok, F.struct(*[c.alias(n) for n, c in (base | known).items()]))


def nginx(line: Column, fallback: Column, source: str = "nginx_access") -> Column:
    """The extended format first, then CLF or combined. Null for a line that fits neither."""
    line = F.trim(line)
    ext = line.rlike(EXTENDED)
    g = lambda k: F.when(ext, F.regexp_extract(line, EXTENDED, k)).otherwise(F.regexp_extract(line, CLF, k))
    more = lambda k: F.when(ext, F.regexp_extract(line, EXTENDED, k)).otherwise("")
    ip, how = real_ip(g(1), more(8), more(9), more(10))
    parsed = access_time(g(2), F.lit(None))
    return _event(
        source, line, ext | line.rlike(CLF), ts=F.coalesce(parsed, fallback).cast("long"), ts_parse_ok=parsed.isNotNull(), source_ip=ip, edge_ip=g(1), client_ip_from=how,
        method=request_part(g(3), 0), path=request_part(g(3), 1), status=number(g(4), "int"), bytes_sent=number(g(5), "long"), referer=undash(g(6)), user_agent=undash(g(7)),
    )


def apache(line: Column, fallback: Column) -> Column:
    return nginx(line, fallback, "apache_access")


def tomcat(line: Column, fallback: Column) -> Column:
    """P5: status and bytes must be there."""
    line = F.trim(line)
    g = lambda k: F.regexp_extract(line, TOMCAT, k)
    parsed = access_time(g(2), F.lit(None))
    return _event(
        "tomcat_access", line, line.rlike(TOMCAT), ts=F.coalesce(parsed, fallback).cast("long"), ts_parse_ok=parsed.isNotNull(), source_ip=g(1),
        method=request_part(g(3), 0), path=request_part(g(3), 1), status=number(g(4), "int"), bytes_sent=number(g(5), "long"), referer=undash(g(6)), user_agent=undash(g(7)),
    )


def syslog_time(month: Column, day: Column, time: Column, now: Column) -> tuple[Column, Column]:
    """Month number and a function of the year for syslog stamps without one."""
    num = lambda y: F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", y.cast("string"), month, day, time), F.lit("yyyy MMM d HH:mm:ss")))
    index = F.array_position(F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]), month)
    return index, num


def linux_auth(line: Column, fallback: Column) -> Column:
    """Sshd lines. `fallback` (Unix seconds) also stands for now when the year is inferred."""
    line = F.trim(line)
    g = lambda k: F.regexp_extract(line, AUTH, k)
    now = F.timestamp_seconds(fallback)
    index, at = syslog_time(g(1), g(2), g(3), now)
    year = F.year(now) - F.when(index > F.month(now) + 9, 1).otherwise(0)
    parsed = at(year)
    return _event(
        "linux_auth", line, line.rlike(AUTH), ts=F.coalesce(parsed, fallback).cast("long"), ts_parse_ok=parsed.isNotNull(),
        source_ip=F.regexp_extract(g(6), AUTH_IP, 1), auth_action=g(6), auth_user=F.regexp_extract(g(6), AUTH_USER, 1),
    )


def custom(pattern: str, groups: Mapping[str, int], source: str = "custom") -> Callable[[Column, Column], Column]:
    """A parser from a regex and the numbers of its groups {ip, time, request, status, bytes, referer, uagent, xff}."""
    import re

    most = re.compile(pattern).groups

    def parse(line: Column, fallback: Column) -> Column:
        line = F.trim(line)
        g = lambda n: F.regexp_extract(line, pattern, groups[n]) if 0 < groups.get(n, 0) <= most else F.lit("")
        xff = F.trim(F.substring_index(undash(g("xff")), ",", 1))
        parsed = access_time(g("time"), F.lit(None))
        return _event(
            source, line, line.rlike(pattern), ts=F.coalesce(parsed, fallback).cast("long"), ts_parse_ok=parsed.isNotNull(), source_ip=F.when(xff != "", xff).otherwise(g("ip")),
            method=request_part(g("request"), 0), path=request_part(g("request"), 1), status=number(g("status"), "int"), bytes_sent=number(g("bytes"), "long"),
            referer=undash(g("referer")), user_agent=undash(g("uagent")),
        )

    return parse


def port_scan(line: Column, fallback: Column, prefix: str = "[PORT_SCAN]") -> Column:
    """Source, port and time of a packet-filter line; null unless it has the prefix and a port from 1 to 65535."""
    port = F.regexp_extract(line, PORT_TARGET, 1).try_cast("int")
    src = F.regexp_extract(line, PORT_SOURCE, 1)
    words = F.split(F.trim(line), "\\s+")
    now = F.timestamp_seconds(fallback)
    _, at = syslog_time(F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.get(words, F.lit(2)), now)
    ts = at(F.year(now))
    ts = F.when(ts > fallback + 3600, at(F.year(now) - 1)).otherwise(ts)
    ok = line.contains(prefix) & (src != "") & port.between(1, 65535)
    return F.when(ok, F.struct(src.alias("src_ip"), port.alias("dst_port"), F.coalesce(ts, fallback).cast("long").alias("ts"), line.alias("raw_line")))


#: Parsers by name.
PARSERS: dict[str, Callable[[Column, Column], Column]] = {"nginx": nginx, "apache": apache, "tomcat": tomcat, "linux_auth": linux_auth}


def register(name: str, parser: Callable[[Column, Column], Column]) -> None:
    if name in PARSERS:
        raise ValueError(f"parser {name!r} is already there")
    PARSERS[name] = parser


def parse(lines: DataFrame, parser: str, fallback: Column, column: str = "value") -> DataFrame:
    """The events of a table of lines; lines that do not parse are left out."""
    return lines.select(PARSERS[parser](F.col(column), fallback).alias("e")).where("e is not null").select("e.*")


def rejected(lines: DataFrame, parser: str, fallback: Column, column: str = "value") -> DataFrame:
    """The lines that do not parse."""
    return lines.where(PARSERS[parser](F.col(column), fallback).isNull())
