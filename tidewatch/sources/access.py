"""Access-log views over the `events`, `documents` and `pages` tables, and readers of real logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsers

EPOCH = 1704067200
PATHS = [
    "/", "/index.html", "/static/app.js", "/static/site.css", "/api/v1/orders/12345", "/api/v1/users/7", "/login", "/favicon.ico",
    "/.env", "/admin/login", "/wp-admin", "/phpmyadmin/", "/etc/passwd", "/api/search?q=union%20select%201", "/files/../../etc/shadow", "/api/v1/orders/98765432",
    "/%61dmin/login", "/%252e%252e%252fetc/passwd", "/a/./b//c", "/search?q=&#60;script&#62;", "/search?q=%5Cu003cscript%5Cu003e", "/shop?item=1%20union%20select%202", "/cgi\\x2fbin", "//wp-admin/./",
]
AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36", "Mozilla/5.0 (X11; rv:121.0) Gecko/20100101 Firefox/121.0", "okhttp/4.9.0",
    "python-requests/2.28.0", "sqlmap/1.7", "Mozilla/5.0 (compatible; Nmap Scripting Engine)", "",
]
THREAT = T.StructType([T.StructField("ip", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("vote_count", T.IntegerType()), T.StructField("source", T.StringType())])


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One web request per event, four a second, from 15 addresses: browsers, API clients and scanners, some of whose paths are encoded."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    n, u, kind = F.col("event_id"), F.col("user_id") % 15, F.col("event_type")
    odd = F.when(n % 3 == 0, "HEAD").when(n % 3 == 1, "DELETE").otherwise("GET")
    failed = F.when((n % 6).isin(0, 1), 404).when(n % 6 == 2, 401).when(n % 6 == 3, 403).when(n % 6 == 4, 500).otherwise(499)
    return e.select(
        n.alias("seq"),
        (EPOCH + F.floor(n / 4)).cast("long").alias("ts"),
        F.concat(F.lit("198.51.100."), (u + 1).cast("string")).alias("source_ip"),
        F.when(u < 10, "nginx_access").when(u < 13, "apache_access").otherwise("tomcat_access").alias("source"),
        F.when(kind.isin("click", "view"), "GET").when(kind.isin("signup", "purchase"), "POST").otherwise(odd).alias("method"),
        _pick(PATHS, F.when(u < 10, n % 8).otherwise(n % 24)).alias("path"),
        F.when(kind != "error", F.when(n % 10 == 0, 302).otherwise(200)).otherwise(failed).cast("int").alias("status"),
        F.floor(F.col("value") * 100).cast("long").alias("bytes_sent"),
        _pick(AGENTS, F.when(u < 6, u % 2).when(u < 10, 2 + u % 2).otherwise(4 + u % 3)).alias("user_agent"),
        F.when((n % 5 < 3) & (u < 10), "https://example.com/").otherwise("").alias("referer"),
    )


def lines(events: DataFrame) -> DataFrame:
    """The events as combined log lines, in a column `value` beside seq."""
    dash = lambda c: F.when(F.col(c) == "", "-").otherwise(F.col(c))
    when = F.date_format(F.timestamp_seconds("ts"), "dd/MMM/yyyy:HH:mm:ss")
    text = F.concat("source_ip", F.lit(" - - ["), when, F.lit(' +0000] "'), "method", F.lit(" "), "path", F.lit(' HTTP/1.1" '), F.col("status").cast("string"), F.lit(" "), F.col("bytes_sent").cast("string"), F.lit(' "'), dash("referer"), F.lit('" "'), dash("user_agent"), F.lit('"'))
    return events.select("seq", text.alias("value"))


def port_events(events: DataFrame) -> DataFrame:
    return events.select("seq", F.col("source_ip").alias("src_ip"), (1 + F.col("seq") * 7919 % 60).cast("int").alias("dst_port"), "ts")


def intel(events: DataFrame) -> DataFrame:
    """Threat scores for each address seen: ip, score, vote_count, source."""
    n = F.substring_index("source_ip", ".", -1).cast("int")
    name = F.when(n % 3 == 0, "global").when(n % 3 == 1, "private").otherwise("")
    return events.select(F.col("source_ip").alias("ip"), (10.0 * (n % 11)).alias("score"), (n * 7 % 25).cast("int").alias("vote_count"), name.alias("source")).distinct()


def read_log(spark: SparkSession, path: str, parser: str, fallback: Column, limit: int | None = None) -> DataFrame:
    """The events of log files; `limit` reads as many lines of the head as the preload allows."""
    raw = spark.read.text(path)
    return parsers.parse(raw.limit(limit) if limit else raw, parser, fallback)


def stream_log(spark: SparkSession, folder: str, parser: str, fallback: Column, files_per_trigger: int = 100) -> DataFrame:
    """Events of files that appear in a folder; rotation makes new files, the checkpoint keeps the place, a rate limit replaces dropping."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parsers.parse(raw, parser, fallback)


def stream_ports(spark: SparkSession, folder: str, fallback: Column, prefix: str = "[PORT_SCAN]") -> DataFrame:
    """Port events of packet-filter lines in a folder."""
    raw = spark.readStream.text(folder)
    return raw.select(parsers.port_scan(F.col("value"), fallback, prefix).alias("e")).where("e is not null").select("e.*")


def port_source(spark: SparkSession, kind: str, folder: str, fallback: Column) -> DataFrame:
    """Packet-filter lines; raw packet capture is not available."""
    if kind in ("auto", "iptables"):
        return stream_ports(spark, folder, fallback)
    raise NotImplementedError(f"no port source {kind!r}")


def merged(*sources: DataFrame) -> DataFrame:
    """Several sources as one."""
    return reduce(DataFrame.unionByName, sources)


def read_intel(spark: SparkSession, path: str) -> DataFrame:
    """Threat scores from JSON files, with a fixed schema and wrong types as nulls."""
    return spark.read.schema(THREAT).json(path)
