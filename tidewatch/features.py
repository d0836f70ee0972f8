"""Built-in feature lists and thresholds of the detector, and their three-layer merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Results depend on these lists, so they must hold exactly these entries.
SENSITIVE_PATHS = [
    "actuator", "env", "phpmyadmin", "wp-admin", "backup", "admin", "console", "manager", "phpinfo",
    "swagger", "swagger-ui", "swagger-resources", "druid", "hystrix", "nacos", "sentinel", ".git", ".env",
    "../../", "..\\", "%2e%2e", "etc/passwd", "dedecms", "ckeditor", "templets", "thinkphp", "upload20",
    "member/templets", "include/ckeditor", "hnap1", "evox/about", "nmaplowercheck", "weblogic", "jboss", "struts",
]
BOT_AGENTS = [
    "curl", "wget", "nikto", "sqlmap", "nmap", "masscan", "dirbuster", "gobuster", "wfuzz", "hydra", "metasploit",
    "burpsuite", "zgrab", "censys", "shodan", "zoomeye", "nmap scripting", "nessus", "acunetix", "qualys", "openvas",
    "httrack", "w3af", "arachni", "skipfish",
]
KNOWN_CLIENTS = [
    "okhttp", "apache-httpclient", "resttemplate", "webclient", "httpclient", "java/", "python-requests", "httpx",
    "aiohttp", "go-http-client", "axios", "fetch", "postman", "insomnia",
]
BROWSER_AGENTS = ["chrome/", "firefox/", "edg/", "opr/", "opera", "msie ", "trident/", "vivaldi/", "yabrowser", "duckduckgo", "brave/"]
STATIC_EXTENSIONS = [".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot"]
DANGEROUS_METHODS = ["CONNECT", "TRACE", "DELETE", "PUT", "PATCH", "OPTIONS"]
STANDARD_METHODS = ["GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT"]
AUTH_FAILURES = ["Failed password", "Invalid user", "Connection closed by authenticating user", "error: PAM: Authentication failure", "maximum authentication attempts"]
SKIP_PATHS = ["/favicon.ico", "/favicon.png", "/robots.txt", "/.well-known/"]
BLOCKED_EXTENSIONS = [".php", ".phtml", ".phar", ".php5", ".php7", ".jsp", ".jspx", ".asp", ".aspx", ".ashx", ".cgi", ".pl", ".htaccess", ".htpasswd"]
BLOCKED_MIMES = ["application/x-php", "application/x-httpd-php", "text/x-php"]
BODY_TYPES = ["application/json", "application/x-www-form-urlencoded", "multipart/form-data", "application/xml", "text/xml"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp"]
DANGEROUS_PATTERNS = [
    # SQL injection
    "select ", "insert into", "update set", "delete from", "drop table", "drop database", "union select", "or 1=1",
    "or '1'='1", "' or ", "';--", "admin'--", "xp_cmdshell", "information_schema", "sleep(", "benchmark(",
    "extractvalue(", "load_file(", "concat(",
    # cross-site scripting
    "<script", "</script>", "javascript:", "onerror=", "onload=", "onclick=", "alert(", "document.cookie", "eval(",
    # path traversal
    "../", "..\\", "%2e%2e", "etc/passwd", "etc/shadow", "proc/self", "boot.ini", "win.ini", "web.config", "wp-config.php",
    # command injection
    "; cat ", "; ls ", "; wget ", "; curl ", "; rm ", "|cat ", "|ls ", "|wget ", "|curl ", "|rm ", "backtick", "$(",
    "system(", "exec(", "passthru(", "shell_exec(", "popen(", "proc_open(",
    # file inclusion, directory services, templates
    "file_get_contents(", "include(", "require(", "include_once(", "require_once(", "\\)(|(", "\\)(&(", "${", "{{", "<%=",
    # internal addresses
    "127.0.0.1", "0.0.0.0", "localhost", "192.168.", "10.", "172.16.", "metadata", "169.254.",
]

#: Most entries of a fetched list by category, cut before sorting and deduplication.
FETCHED_CAPS = {"path": 500, "ua": 200}
#: Cap of other categories, and parts over which the rows of a category are dealt.
OTHER_CAP, PARTS = 500, 64


def merge_lists(builtin: DataFrame, cloud: DataFrame, local: DataFrame, excludes: DataFrame, use_builtin: bool = True, use_cloud: bool = True) -> DataFrame:
    """Item, sources of the union of the enabled layers without the excluded items. Inputs have a column `item`.

    Items are trimmed, blanks dropped; `sources` joins the layers that have the item in the order builtin, cloud, local.
    """
    layers = [(builtin, 1, "builtin", use_builtin), (cloud, 2, "cloud", use_cloud), (local, 3, "local", True)]
    rows = [df.select(F.trim("item").alias("item"), F.lit(rank).alias("rank"), F.lit(name).alias("source")) for df, rank, name, on in layers if on]
    union = reduce(DataFrame.unionByName, rows).where("item != ''").distinct()
    kept = union.join(excludes.select(F.trim("item").alias("item")).distinct(), "item", "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "source")))
    return kept.groupBy("item").agg(F.array_join(F.transform(ordered, lambda s: s["source"]), "+").alias("sources"))


def merge_all(layers: dict[str, tuple[DataFrame, DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """The merge of every named list, with the list's name."""
    return reduce(DataFrame.unionByName, (merge_lists(*x).withColumn("list", F.lit(n)) for n, x in layers.items()))


def by_category(rows: DataFrame, fallback: str = "path", most: int | None = None) -> DataFrame:
    """U4: category, items of fetched rows (category, value, ord); a missing category falls back.

    `most` leaves the first entries of each category only, found in dealt parts, so that no task collects a whole category.
    """
    key = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit(fallback)).alias("category")
    rows = rows.select(key, "ord", "value")
    if most is not None:
        first = lambda df, *by: df.withColumn("_n", F.row_number().over(Window.partitionBy("category", *by).orderBy("ord", "value"))).where(F.col("_n") <= most)
        rows = first(first(rows.withColumn("_part", F.pmod(F.xxhash64("ord", "value"), F.lit(PARTS))), "_part"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda s: s["value"])
    return rows.groupBy("category").agg(items.alias("items"))


def capped(lists: DataFrame) -> DataFrame:
    """The first entries of each list up to its cap, then distinct and sorted."""
    cap = reduce(lambda c, kv: c.when(F.col("category") == kv[0], kv[1]), FETCHED_CAPS.items(), F.when(F.lit(False), 0)).otherwise(OTHER_CAP)
    return lists.select("category", F.array_sort(F.array_distinct(F.slice("items", F.lit(1), cap))).alias("items"))


def is_newer(version: int | None, known: int | None) -> bool:
    """Whether a fetched version must replace the known one."""
    return version is not None and (known is None or version != known)
