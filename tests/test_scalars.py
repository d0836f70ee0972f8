import pytest
from pyspark.sql import functions as F

from tidewatch.functions import decoding, parsers
from tidewatch.functions import scalars as S


def values(spark, column, *texts):
    rows = [(i, *t) if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    names = ["i"] + ["x", "y"][: len(rows[0]) - 1]
    return [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'i' else 'string'}" for n in names)).orderBy("i").select(column).collect()]


def test_sensitive_paths(spark):
    cases = {"/.env": True, "/tdsc/js/env.js": False, "/admin.js": False, "/myactuator": False, "/file/../../etc/passwd": True, "/admin?user=test": True, "/api/env": True, "/": False}
    assert values(spark, S.hit_sensitive_path(F.col("x")), *cases) == list(cases.values())


def test_normalize_404(spark):
    cases = {
        "/": "/", "": "/", "/api/item/9999": "/api/item/{id}", "/api/item/1": "/api/item/1", "/A/B/C/D/E?q=1": "/a/b/c/d",
        "/u/123e4567-e89b-12d3-a456-426614174000": "/u/{id}", "/x/0123456789abcdef01234567/": "/x/{id}", "//a///b": "/a/b",
    }
    assert values(spark, S.normalize_404_path(F.col("x")), *cases) == list(cases.values())


def test_agents(spark):
    browsers = ["Mozilla/5.0 Chrome/120.0 Safari/537.36", "Mozilla/5.0 Version/17 Safari/605", "Mozilla/5.0 (X11; rv:121.0) Gecko/20100101 Firefox/121.0", "Mozilla/5.0 Trident/7.0; rv:11.0"]
    others = ["", "-", "okhttp/4.9.0", "sqlmap/1.7", "Mozilla/5.0 (compatible; Nmap Scripting Engine)", "python-requests/2.28.0"]
    assert values(spark, S.is_browser_agent(F.col("x")), *browsers, *others) == [True] * 4 + [False] * 6
    assert values(spark, S.is_bot_agent(F.col("x")), *browsers, *others) == [False] * 4 + [False, False, False, True, True, False]


def test_uploads_methods_and_addresses(spark):
    assert values(spark, S.upload_blocked(F.col("x"), F.lit("")), "a.php", "a.PHP ", "a.jpg.php", "a.php.png", "a.png", ".htaccess", "php") == [True, True, True, True, False, True, False]
    assert values(spark, S.is_malformed(F.col("x"), F.col("y")), ("GET", "/"), ("\x16\x03", "/"), ("", "/"), ("GET", "/\x01"), ("get", "/\t"), ("GET", "/\x7f")) == [False, True, False, True, False, True]
    assert values(spark, S.is_private(F.col("x")), "10.1.2.3", "172.31.0.1", "172.32.0.1", "192.168.0.1", "8.8.8.8", "::1", "fe80::1", "2001:db8::1", "x", "169.254.1.1") == [True, True, False, True, False, True, True, False, False, True]
    assert values(spark, S.to_cidr(F.col("x")), "1.2.3.4", "::1", "1.0.0.0/8") == ["1.2.3.4/32", "::1/128", "1.0.0.0/8"]
    assert values(spark, S.uptime(F.col("x").cast("long")), "5", "65", "3700", "90061") == ["5s", "1m 5s", "1h 1m 40s", "1d 1h 1m 1s"]


@pytest.mark.parametrize(("text", "want"), [("%27%20OR%201%3D1--", "' OR 1=1--"), ("&#60;script&#62;", "<script>"), ("%252e%252e%252f", "../"), ("a%zz+b", "a%zz+b"), ("\\u003cscript\\x3e", "<script>"), ("a+b", "a b"), ("&lt;b&gt;", "<b>"), ("&slash;&backslash;", "/\\"), ("&sol;&bsol;", "&sol;&bsol;"), ("\\U003cq", "<q"), ("\\xa0\\xad\\xa1", "\\xa0\\xad\u00a1")])
def test_decode(text, want):
    assert decoding.decode(text) == want


def test_decoding_columns(spark):
    assert values(spark, decoding.has_traversal(F.col("x")), "/a/../b", "/a..b", "/%2e%2e/x", "/%252e%252e%252fx", "..\\x", "/ok") == [True, False, True, True, True, False]
    n = decoding.normalize_request_path(F.col("x"))
    assert [tuple(r) for r in values(spark, n, "/files/../../etc/shadow?x=1", "/a//b/./c/", "")] == [("/etc/shadow", True), ("/a/b/c/", False), ("/", False)]
    assert values(spark, decoding.valid_ip(F.col("x")), "1.2.3.4", "1.2.3.0/24", "::1", "2001:db8::/32", "1.2.3", "x") == [True, True, True, True, False, False]
    assert values(spark, decoding.in_networks(["10.0.0.0/8", "fd00::/8"])(F.col("x")), "10.1.1.1", "fd00::1", "11.1.1.1", "x") == [True, True, False, False]


def test_bodies():
    p = ["union select", "<script"]
    assert decoding.scan_text("application/json; charset=utf-8", '{"a": {"b": ["x UNION select y"]}}', p, 10_240) == 1
    assert decoding.scan_text("application/json", '{"union select": 1}', p, 10_240) == 0
    assert decoding.scan_text("application/json", "not json <script>", p, 10_240) == 1
    assert decoding.scan_text("application/x-www-form-urlencoded", "a=union+select&b=%3Cscript", p, 10_240) == 2
    assert decoding.scan_text("text/plain", "<script", p, 10_240) == 0
    assert decoding.scan_text("application/json", '{"a": "<script", "b": ["<SCRIPT"]}', p, None) == 2
    assert decoding.scan_text("application/json", '{"a": NaN, "<script": 1}', p, None) == 1
    assert decoding.scan_text("multipart/form-data; boundary=x", "a=<script&b=%3cscript", p, None) == 2
    assert decoding.scan_text("multipart/form-data", "--x; name=a <script union select", p, None) == 2
    assert decoding.scan_text("application/x-www-form-urlencoded", "a=%zz%3cscript&b=%3cscript", p, None) == 1
    assert decoding.scan_text("text/xml", "%zz%3cscript", p, None) == 1
    assert decoding.scan_text("text/xml", "<!DOCTYPE x [<!ENTITY y '<script'>]>", p, None) == 2


def test_body_columns(spark):
    rows = [("text/xml", "<!DOCTYPE a [<!ENTITY b>]>"), ("application/soap+xml", "<!DOCTYPE a [<!ENTITY b>]>"), ("text/xml", " " * 10_240 + "<!doctype entity"), (None, None), ("application/json", "<!doctype entity <script")]
    s = spark.createDataFrame(rows, "kind string, body string").select(decoding.body_scan(F.col("kind"), F.col("body"), ["<script"]).alias("s")).select("s.*")
    assert [tuple(r) for r in s.collect()] == [(1, True), (0, False), (0, False), (0, False), (1, False)]


LINES = {
    '127.0.0.1 - - [10/Oct/2023:13:55:36 +0000] "GET / HTTP/1.1" 200 612': ("127.0.0.1", "GET", "/", 200, 612, "direct", 1696946136),
    '127.0.0.1 - - [10/Oct/2023:13:55:36 +0000] "GET / HTTP/1.1"': ("127.0.0.1", "GET", "/", 0, 0, "direct", 1696946136),
    '127.0.0.1 - - [10/Oct/2023:13:55:36 +0000] "GET / HTTP/1.1" 200 -': ("127.0.0.1", "GET", "/", 200, 0, "direct", 1696946136),
    '203.0.113.100 54321 - - [28/Aug/2026:09:10:00 +0800] "GET /api/users HTTP/1.1" 200 1234 "https://example.com" "Mozilla/5.0" "10.0.0.1, 172.16.0.1"': ("10.0.0.1", "GET", "/api/users", 200, 1234, "xff", 1787879400),
    '104.16.132.229 54321 - - [28/Aug/2026:09:10:00 +0800] "GET /a HTTP/1.1" 200 1 "-" "-" "6.6.6.6" "-" "8.8.8.8"': ("8.8.8.8", "GET", "/a", 200, 1, "true_client_ip", 1787879400),
    '104.16.132.229 54321 - - [28/Aug/2026:09:10:00 +0800] "GET /a HTTP/1.1" 200 1 "-" "-" "222.132.94.196" "222.132.94.196" ""': ("222.132.94.196", "GET", "/a", 200, 1, "cf_connecting_ip", 1787879400),
    '104.16.132.229 54321 - - [bad time] "broken" 200 1 "-" "-" "-" "-" "-"': ("104.16.132.229", "", "", 200, 1, "direct", 7),
}


def test_nginx_lines(spark):
    got = values(spark, parsers.nginx(F.col("x"), F.lit(7)), *LINES, "garbage without structure", "  ")
    assert [(r["source_ip"], r["method"], r["path"], r["status"], r["bytes_sent"], r["client_ip_from"], r["ts"]) for r in got[:-2]] == list(LINES.values())
    assert got[-2:] == [None, None]


def test_other_lines(spark):
    tomcat = values(spark, parsers.tomcat(F.col("x"), F.lit(0)), '1.2.3.4 - - [10/Oct/2023:13:55:36 +0000] "GET /x HTTP/1.1" 404 -', '1.2.3.4 - - [10/Oct/2023:13:55:36 +0000] "GET /x HTTP/1.1"')
    assert tomcat[0]["status"] == 404 and tomcat[1] is None
    auth = values(spark, parsers.linux_auth(F.col("x"), F.lit(1704067200)), "Mar 2 16:38:12 host sshd[1234]: Failed password for invalid user root from 1.2.3.4 port 12345 ssh2", "Mar 2 16:38:12 host sshd[1]: Connection closed by 1.2.3.4 [preauth]", "Dec 31 23:59:59 web01 sshd[99]: Failed password for admin from 10.0.0.1 port 54321 ssh2")
    assert [(r["source_ip"], r["auth_user"]) for r in auth] == [("1.2.3.4", "root"), ("", ""), ("10.0.0.1", "admin")]
    assert auth[2]["ts"] == 1704067199
    port = values(spark, parsers.port_scan(F.col("x"), F.lit(1788084000)), "Aug 30 10:00:01 kernel: [PORT_SCAN]: IN=eth0 SRC=192.168.1.100 DST=10.0.0.5 PROTO=TCP SPT=12345 DPT=22", "Aug 30 10:00:01 kernel: SRC=1.1.1.1 DPT=22", "[PORT_SCAN] SRC=1.1.1.1 DPT=70000")
    assert (port[0]["src_ip"], port[0]["dst_port"], port[0]["ts"]) == ("192.168.1.100", 22, 1788084001) and port[1:] == [None, None]


def test_registry():
    with pytest.raises(ValueError):
        parsers.register("nginx", parsers.nginx)
