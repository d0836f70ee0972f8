"""DuckDB texts of the registered queries, for those that SQL can express."""

from __future__ import annotations

from .. import features
from ..functions import parsers
from ..sources.access import AGENTS, EPOCH, PATHS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(items: list[str]) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def any_like(text: str, items: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {q(x)})" for x in items) + ")"


def any_end(text: str, items: list[str]) -> str:
    return "(" + " or ".join(f"ends_with({text}, {q(x)})" for x in items) + ")"


U = "(user_id % 15)"
ACCESS = f"""access as (select event_id as seq, cast({EPOCH} + floor(event_id / 4.0) as bigint) as ts,
  concat('198.51.100.', cast({U} + 1 as varchar)) as source_ip,
  case when {U} < 10 then 'nginx_access' when {U} < 13 then 'apache_access' else 'tomcat_access' end as source,
  case when event_type in ('click', 'view') then 'GET' when event_type in ('signup', 'purchase') then 'POST'
    else case when event_id % 3 = 0 then 'HEAD' when event_id % 3 = 1 then 'DELETE' else 'GET' end end as method,
  list_extract({array(PATHS)}, cast(case when {U} < 10 then event_id % 8 else event_id % 24 end as bigint) + 1) as path,
  cast(case when event_type <> 'error' then case when event_id % 10 = 0 then 302 else 200 end
    else case event_id % 6 when 0 then 404 when 1 then 404 when 2 then 401 when 3 then 403 when 4 then 500 else 499 end end as int) as status,
  cast(floor(value * 100) as bigint) as bytes_sent,
  list_extract({array(AGENTS)}, cast(case when {U} < 6 then {U} % 2 when {U} < 10 then 2 + {U} % 2 else 4 + {U} % 3 end as bigint) + 1) as user_agent,
  case when event_id % 5 < 3 and {U} < 10 then 'https://example.com/' else '' end as referer from events)"""

BARE = "split_part(path, '?', 1)"
PART = f"list_filter(string_split(lower(rtrim({BARE}, '/')), '/'), lambda s: s <> '')"
VAR = "((length(s) = 36 and length(s) - length(replace(s, '-', '')) = 4) or regexp_matches(s, '^[0-9]{4,}$') or regexp_matches(s, '^[0-9a-f]{24,}$'))"
BASE = f"concat('/', array_to_string(list_slice(list_transform({PART}, lambda s: case when {VAR} then '{{id}}' else s end), 1, 4), '/'))"
SENS = f"""({any_like(f'lower({BARE})', [k for k in features.SENSITIVE_PATHS if '/' in k])}
  or list_has_any(string_split(lower({BARE}), '/'), {array([k for k in features.SENSITIVE_PATHS if '/' not in k])}))"""
STATIC = any_end(f"lower({BARE})", features.STATIC_EXTENSIONS)
# What decoding and cleaning make of the paths of the view that need more than one step, written out.
SEEN = {
    "/%252e%252e%252fetc/passwd": "/../etc/passwd", "/search?q=&#60;script&#62;": "/search?q=<script>", "/search?q=%5Cu003cscript%5Cu003e": "/search?q=<script>", "/cgi\\x2fbin": "/cgi/bin",
}
CLEANED = {
    "/%61dmin/login": "/admin/login", "/%252e%252e%252fetc/passwd": "/etc/passwd", "/a/./b//c": "/a/b/c", "/cgi\\x2fbin": "/cgi/bin", "//wp-admin/./": "/wp-admin/", "/files/../../etc/shadow": "/etc/shadow",
}


def mapped(column: str, known: dict[str, str], else_: str) -> str:
    return f"case {column} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in known.items()) + f" else {else_} end"


DECODED = "lower(" + mapped("{0}", SEEN, "replace(url_decode({0}), '+', ' ')") + ")"
CLEAN = "clean as (select * replace (" + mapped("path", CLEANED, BARE) + " as path), path as raw from access)"
BOT = f"(not {any_like('lower(user_agent)', features.KNOWN_CLIENTS)} and {any_like('lower(user_agent)', features.BOT_AGENTS)})"
BROWSER = f"""(user_agent not in ('', '-') and not {any_like('lower(user_agent)', features.BOT_AGENTS)} and not {any_like('lower(user_agent)', features.KNOWN_CLIENTS)}
  and ((contains(lower(user_agent), 'safari/') and not contains(lower(user_agent), 'chrome/')) or (contains(lower(user_agent), 'trident/') and contains(lower(user_agent), 'rv:'))
  or {any_like('lower(user_agent)', features.BROWSER_AGENTS)}))"""
IND = {
    "total": "true", "c404": "status = 404", "c401": "status = 401", "c4xx": "status between 400 and 499 and status not in (404, 499)",
    "c5xx": "status between 500 and 599", "auth_fail": "false", "sens": f"status >= 400 and {SENS}",
    "trav": f"regexp_matches({DECODED.format('raw')}, '(^|[/\\\\])\\.\\.([/\\\\]|$)') or contains({DECODED.format('raw')}, '%2e%2e')",
    "danger": any_like(DECODED.format("raw"), features.DANGEROUS_PATTERNS), "bot": BOT, "browser": BROWSER, "empty_ref": "referer in ('', '-')", "static": STATIC,
    "dmethod": f"upper(method) in ({', '.join(map(q, features.DANGEROUS_METHODS))})", "head": "upper(method) = 'HEAD'", "upload": "false",
}
CLEAN_ACCESS = f"{ACCESS}, {CLEAN}"
INDICATED = f"{CLEAN_ACCESS}, ind as (select *, " + ", ".join(f"cast(case when {c} then 1 else 0 end as bigint) as {n}" for n, c in IND.items()) + " from clean)"
ACCESS_PATHS = f"{ACCESS}, paths as (select distinct path from (select path from access union all select regexp_replace(url, '^[a-z]+://[^/]+', '') from pages))"
IPN = "list_reduce(list_transform(string_split({0}, '.'), lambda x: cast(x as bigint)), lambda a, b: a * 256 + b)"


def counters(w: int) -> str:
    so_far = "partition by source_ip order by ts, seq rows between unbounded preceding and current row"
    before = f"partition by source_ip order by ts range between unbounded preceding and {w} preceding"
    return f"with {INDICATED} select seq, " + ", ".join(f"cast(sum({n}) over ({so_far}) - coalesce(sum({n}) over ({before}), 0) as bigint) as {n}_{w}" for n in IND) + " from ind"


def distinct_bases() -> str:
    one = lambda n, c, w: f"count(distinct case when b.ts > a.ts - {w} and {c} then b.base end) as d{n}_{w}"
    cols = ", ".join(one(n, c, w) for w in (10, 30, 60) for n, c in (("404", "b.status = 404"), ("4xx", "b.status between 400 and 498 and b.status <> 404")))
    return f"with {CLEAN_ACCESS}, x as (select *, {BASE} as base from clean) select a.seq, {cols} from x a join x b on a.source_ip = b.source_ip and b.ts > a.ts - 60 and b.ts <= a.ts and b.seq <= a.seq group by a.seq"


TICKS = f"""{INDICATED}, tick as (select unnest(range(cast(ceil(ts / 10.0) * 10 as bigint), ts + 60, 10)) as tick, * from ind),
  snap as (select tick, source_ip, {', '.join(f'cast(sum({n}) as bigint) as {n}' for n in IND)} from tick group by tick, source_ip)"""
RATIO = "case when {0} <= 0 or total <= 0 then 0.0::double else {0}::double / total end"
ATTACK = f"(total < 5 or {RATIO.format('c4xx')} > 0.8 or {RATIO.format('c404')} > 0.8 or {RATIO.format('bot')} > 0.9 or danger >= 3 or trav >= 3)"
RATES = {"r4xx": "c4xx", "r5xx": "c5xx", "r404": "c404", "auth": "auth_fail", "sens": "sens", "bot": "bot", "empty_ref": "empty_ref", "head": "head"}
SAMPLES = f"{TICKS}, s as (select tick, 'qps' as dim, total / 60.0::double as value from snap where not {ATTACK}" + "".join(f" union all select tick, '{d}', {RATIO.format(c)} from snap where not {ATTACK}" for d, c in RATES.items()) + ")"
TRIMMED = f"""{SAMPLES}, g as (select tick, dim, list_sort(list(value)) as l, count(*) as n from s group by tick, dim),
  m as (select *, list_extract(l, n // 2 + 1) as med from g), m2 as (select *, list_extract(list_sort(list_transform(l, lambda x: abs(x - med))), n // 2 + 1) as mad from m),
  k as (select tick, dim, case when n < 5 or mad <= 0 then l else list_filter(l, lambda x: x <= med + 5.0::double * mad) end as l from m2),
  k2 as (select *, len(l) as n, list_extract(l, cast(floor(len(l) * 0.99::double) as bigint) + 1) as top from k),
  h as (select tick, dim, case when n < 5 or top <= 0 then l else list_filter(l, lambda x: x <= 10.0::double * top) end as l from k2)"""
FLOORS = {"p50": "0.0003::double", "p95": "0.001::double", "p99": "0.003::double"}
CENTILES = {"p50": "0.5::double", "p95": "0.95::double", "p99": "0.99::double"}


def least_rate(p95: str) -> str:
    return f"greatest(0.5::double, least(50.0::double, {p95} * 0.1::double))"


def folded() -> str:
    """`fold` with the baseline after each tick, one step of the recursion a tick."""
    at = ", ".join(f"list_extract(l, cast(floor(len(l) * {x}) as bigint) + 1) as {p}" for p, x in CENTILES.items())
    own = ", ".join(f"case when dim = 'qps' then {p} else greatest({p}, {x}) end as {p}" for p, x in FLOORS.items())
    low = "case when f.p95 > 0 then " + least_rate("f.p95") + " else 0.5::double end"
    raised = lambda t, low: {"p50": f"greatest({t}p50, {low} * 0.3::double)", "p95": low, "p99": f"greatest({t}p99, {low} * 2)"}
    lift = lambda t, low: ", ".join(f"case when dim = 'qps' and {t}p95 < {low} then {x} else {t}{p} end as {p}" for p, x in raised(t, low).items())
    mixed = ", ".join(f"o{p} * d + {p} * (1 - d) as {p}" for p in FLOORS)
    kept = {p: f"case when dim = 'qps' then {p} else greatest({p}, {x}) end" for p, x in FLOORS.items()}
    kept["p95"] = "case when dim = 'qps' then greatest(p95, case when p95 <= 0 then 1.0::double else " + least_rate("p95") + " end) else greatest(p95, " + FLOORS["p95"] + ") end"
    final = ", ".join(f"{x} as {p}" for p, x in kept.items())
    return f"""{TRIMMED}, v as (select tick, dim, len(l) as n, {at} from h),
      t as (select tick, dim, n, row_number() over (partition by dim order by tick) as i, case when tick - {EPOCH} < 1800 then 0.5::double else 0.8::double end as d, {own} from v),
      fold as (select tick, dim, i, n, {lift('', '0.5::double')} from t where i = 1 union all
        select tick, dim, i, n, {final} from (select tick, dim, i, n, {mixed} from (
          select t.tick, dim, t.i, t.n, t.d, f.p50 as op50, f.p95 as op95, f.p99 as op99, {lift('t.', low)} from fold f join t using (dim) where t.i = f.i + 1)))"""


LOOKBACK = f"""{ACCESS}, buckets as (select cast(ts // 300 * 300 as bigint) as bucket, count(*) as total, count(*) filter (status = 404) as n404, count(*) filter (status in (401, 403)) as auth, count(*) filter (status in (401, 403, 400, 405, 408, 429, 422)) as n4xx, count(*) filter (status between 500 and 504) as n5xx from access group by 1),
  ends as (select min(bucket) as lo, max(bucket) as hi from buckets), tries as (select unnest(range(10, 241, 30)) as minutes),
  lists as (select minutes, lo, hi - minutes * 60 as cutoff, list_sort(list(total)) as l from tries, ends, buckets where bucket >= hi - minutes * 60 group by all),
  meds as (select *, greatest(list_extract(l, len(l) // 2 + 1), 1)::double as median from lists), looks as (select *, len(list_filter(l, lambda x: x >= median * 0.5::double)) as healthy from meds),
  look as (select minutes, cutoff, median, len(l) as buckets, healthy from looks where minutes = (select coalesce(min(minutes) filter (healthy >= 10 or lo >= cutoff), max(minutes)) from looks))"""
AT = "round(list_extract(l, cast(floor({0}) as bigint) + 1), 6)"
PCT = f"{AT.format('n / 2.0')} as p50, {AT.format('n * 0.95::double')} as p95, {AT.format('n * 0.99::double')} as p99, n"
SUM = "cast(sum({0}) as bigint)"
LINE_TIME = "strftime(make_timestamp(ts * 1000000), '%d/%b/%Y:%H:%M:%S')"
PARSED = "seq, ts, true as ts_parse_ok, '{0}' as source, source_ip, method, path, status, bytes_sent, referer, user_agent, {1} as edge_ip, {2} as client_ip_from"
RING = f"{CLEAN_ACCESS}, ring as (select * exclude (n), row_number() over (partition by source_ip order by ts, seq) as pos from (select *, row_number() over (partition by source_ip order by ts desc, seq desc) as n from clean) where n <= 512)"
JUDGED = f"{INDICATED}, j as (select *, cast(sens * 30 + danger * 20 + bot * 10 + c4xx * 5 as bigint) as final, sens * 30 + danger * 20 + bot * 10 + c4xx * 5 >= 50 as is_high from ind)"
SEG = f"case when regexp_extract({BARE}, '^/*([^/]+)', 1) = '' then '/' else regexp_extract({BARE}, '^/*([^/]+)', 1) end"
PROBE = "'(?i)^/(favicon\\.ico|robots\\.txt|sitemap\\.xml|crossdomain\\.xml|\\.well-known/.*)$'"
FILE = "'(?i)\\.(css|js|mjs|png|jpe?g|gif|svg|ico|webp|woff2?|ttf|eot|otf|map)$'"


def shape(which: str) -> str:
    """C1-C8 over the last 512 events up to each event of `clean` for which the condition holds: at, ip, total, score, is_benign."""
    return f"""{CLEAN_ACCESS}, p as (select *, {SEG} as seg, row_number() over (partition by source_ip order by ts, seq) as pos, count(*) over (partition by source_ip) as own from clean),
      r as (select *, lag(seg) over (partition by source_ip order by pos) as before from p),
      w as (select a.seq as ev, a.source_ip as ip, least(a.pos, 512) as total, greatest(least(a.pos, 512) // 3, 1) as k, b.pos - greatest(a.pos - 512, 0) as i, b.path, b.status, b.method, b.seg, b.before from r a join r b on a.source_ip = b.source_ip and b.pos between a.pos - 511 and a.pos where {which.format('a')}),
      runs as (select ev, any_value(ip) as ip, max(total) as total, max(k) as k, count(*) filter (i = 1 or seg <> before) as runs, avg(case when method = 'GET' then 1.0::double else 0 end) as g, avg(case when method = 'POST' then 1.0::double else 0 end) as ps, avg(case when method not in ('GET', 'POST') then 1.0::double else 0 end) as u from w group by ev),
      segs as (select ev, max(n) as most from (select ev, seg, count(*) as n from w group by all) group by ev),
      paths as (select ev, path, count(*) as n, max(case when i <= k then 1 else 0 end) as early, count(*) filter (i > total - k) as late, min(status) as least from w group by ev, path),
      nov as (select ev, count(*) as n_paths, sum(early)::double / count(*) as early, coalesce(sum(late) filter (early = 0), 0) as fresh from paths group by ev),
      tops as (select ev, sum(n) as s, bool_or(least >= 400 and case when regexp_matches(path, {PROBE}) then n >= 10 else n >= 5 and not regexp_matches(path, {FILE}) end) as fails from (select *, row_number() over (partition by ev order by n desc, path) as rank from paths) where rank <= 5 group by ev),
      spread as (select ev, path, sum(n) as n, coalesce(stddev_samp(n) / avg(n), 0) as cv from (select ev, path, status, count(*) as n from w group by all) group by ev, path),
      cvs as (select ev, coalesce(round(avg(cv) filter (n >= 3), 3), 0.0) as cv from spread group by ev),
      parts as (select *, fresh::double / k as late, s::double / total as cover, (g between 0.5 and 0.99 and ps between 0.01 and 0.49 and u < 0.05) or (g >= 0.8 and u < 0.01) or (ps >= 0.5 and g > 0.01 and u < 0.05) as fits from runs join segs using (ev) join nov using (ev) join tops using (ev) join cvs using (ev)),
      s as (select ev, ip, total, cast(case when total::double / runs >= 3 or most::double / total >= 0.5 then 2 else 0 end + case when early >= 0.7 and late <= 0.4 then 2 else 0 end + case when cover >= 0.25 then 2 else 0 end + case when cv < 0.6 then 1 else 0 end + case when fits then 1 else 0 end
        - case when fails then 5 else 0 end - case when fails and n_paths < 3 then 3 else 0 end - case when early < 0.5 and late > 0.7 and cover < 0.4 then 3 else 0 end as bigint) as score from parts)
      """


TOP = "top as (select * from (select *, row_number() over (partition by source_ip order by n desc, path) as rank from (select source_ip, path, count(*) as n, min(status) as least from ring group by all)) where rank <= 5)"
N = "cast(split_part(ip, '.', 4) as bigint)"
INTEL = f"intel as (select ip, 10.0 * ({N} % 11) as score, {N} * 7 % 25 as vote_count, case when {N} % 3 = 0 then 'global' when {N} % 3 = 1 then 'private' else '' end as source from (select distinct source_ip as ip from access))"
CONF = "case when source <> 'global' or vote_count <= 0 then 0.7 when vote_count >= 20 then 1.0 when vote_count >= 10 then 0.9 when vote_count >= 5 then 0.75 when vote_count >= 3 then 0.6 when vote_count = 1 then 0.4 else 0.7 end"
DECIDED = f"""{INDICATED}, {INTEL}, now as (select max(ts) as now from access),
  local as (select source_ip as ip, least(sum(c4xx) % 101, 100) as freq, least(sum(sens), 100) as detector, max(ts) as last_seen from ind group by 1),
  b as (select i.*, {CONF} as conf, coalesce(l.freq, 50)::double as f, coalesce(l.detector, 50)::double as d from intel i left join (select local.* from local, now where last_seen >= now - 5) l using (ip)),
  dec as (select ip, vote_count, score::double as cloud_score, conf::double as cloud_confidence, (score * conf)::double as effective_cloud, f as local_freq, d as detector,
    source = 'global' and vote_count >= 20 and score >= 90 as fast_path, round(score::double * conf::double * 0.4::double + f * 0.3::double + d * 0.3::double, 6) as raw from b),
  res as (select * exclude (raw), case when fast_path then 80.0::double else raw end as final_score from dec)"""
NETS = "nets as (select unnest(['198.51.100.0/30', '198.51.100.9', '10.0.0.0/8']) as net)"
IN_NETS = "(split_part({0}, '.', 4) in ('1', '2', '3', '9') and {0} like '198.51.100.%' and {0} not like '%x')"
ENTRIES = f"""{ACCESS}, now as (select max(ts) as now from access), req as (select seq, source_ip as ip, case when seq % 4 < 2 then 'cloud' else 'local' end as source, seq % 5 * 3000 as ttl, ts from access where status = 404),
  e as (select ip, source, cast(case when source = 'cloud' then case when ttl <= 0 then 7200 else least(ttl, 7200) end else case when ttl <= 0 then 3600 else ttl end end as bigint) as ttl, ts from (select ip, max_by(source, seq) as source, max_by(ttl, seq) as ttl, max_by(ts, seq) as ts from req group by ip))"""
CHANGES = "ch as (select seq as ord, case when seq % 3 = 0 then 'white' else 'black' end as set, source_ip as ip, case when status = 302 then 'del' else 'add' end as op from access)"

ORACLES = {
    "access_view": f"with {ACCESS} select * from access",
    "parse_nginx": f"with {ACCESS} select {PARSED.format('nginx_access', 'source_ip', q('direct'))} from access",
    "parse_apache": f"with {ACCESS} select {PARSED.format('apache_access', 'source_ip', q('direct'))} from access",
    "parse_tomcat": f"with {ACCESS} select {PARSED.format('tomcat_access', q(''), q(''))} from access",
    "parse_ext_ip_pick": f"""with {ACCESS} select seq, case seq % 4 when 3 then '6.6.6.6' when 2 then '8.8.8.8' when 1 then '10.0.0.1' else source_ip end as source_ip, source_ip as edge_ip,
      case seq % 4 when 3 then 'cf_connecting_ip' when 2 then 'true_client_ip' when 1 then 'xff' else 'direct' end as client_ip_from, status, path from access""",
    "parse_auth": f"""with {ACCESS}, x as (select *, case seq % 3 when 0 then concat('Failed password for invalid user root from ', source_ip, ' port 12345 ssh2') when 1 then concat('Accepted password for admin from ', source_ip, ' port 12345 ssh2') else concat('Connection closed by ', source_ip, ' [preauth]') end as a from access)
      select seq, ts, case when seq % 3 < 2 then source_ip else '' end as source_ip, case seq % 3 when 0 then 'root' when 1 then 'admin' else '' end as auth_user, a as auth_action, seq % 3 = 0 as failed from x""",
    "parse_custom": f"with {ACCESS} select seq, ts, source_ip, method, path, status, 0::bigint as bytes_sent from access",
    "parse_portscan": f"with {ACCESS} select seq, source_ip as src_ip, cast(1 + seq * 7919 % 60 as int) as dst_port, ts from access where seq % 10 <> 0",
    "unparsable": "select count(*) as lines, " + ", ".join(f"count(*) filter (not regexp_matches(trim(coalesce(text, '')), {q(p)})) as {n}" for n, p in (("nginx", parsers.CLF), ("apache", parsers.CLF), ("tomcat", parsers.TOMCAT), ("linux_auth", parsers.AUTH))) + " from documents",
    "norm404": f"with {ACCESS_PATHS} select path, {BASE} as base from paths",
    "sens_path": f"with {ACCESS_PATHS} select path, {SENS} as hit from paths",
    "first_segment": f"with {ACCESS_PATHS} select path, {SEG} as seg from paths",
    "static_res": f"with {ACCESS_PATHS} select path, {STATIC} as static from paths",
    "path_route": f"with {ACCESS} select case when lower({BARE}) in ('/favicon.ico', '/favicon.png', '/robots.txt') or starts_with(lower({BARE}), '/.well-known/') then 'skipped' else 'scored' end as route, count(*) as n from access group by 1",
    "bot_ua": f"with {ACCESS} select user_agent, count(*) as n, {BOT} as bot, {BROWSER} as browser from access group by user_agent",
    "method_class": f"with {ACCESS} select method, count(*) as n, case method when 'GET' then 'G' when 'POST' then 'P' when 'DELETE' then 'D' when 'HEAD' then 'H' else 'X' end as code, method = 'DELETE' as dangerous, false as malformed from access group by method",
    "danger_patterns": f"with {ACCESS_PATHS}, x as (select path, list_sort(list_filter({array(features.DANGEROUS_PATTERNS)}, lambda p: contains({DECODED.format('path')}, p))) as l from paths) select path, len(l) as n, array_to_string(l, ',') as hits from x",
    "upload_check": f"""with {ACCESS_PATHS}, x as (select path, list_last(string_split({BARE}, '/')) as f from paths), y as (select distinct path, unnest([f, concat(f, '.php'), concat(f, '.jpg.PHP'), concat(f, '.jsp.png')]) as file_name from x)
      select path, file_name, {any_end('lower(trim(file_name))', features.BLOCKED_EXTENSIONS)} or {any_end('lower(trim(file_name))', [b + i for b in features.BLOCKED_EXTENSIONS for i in features.IMAGE_EXTENSIONS])} as blocked from y""",
    "ip_predicates": f"with {ACCESS} select source_ip, count(*) as n, {IPN.format('source_ip')} as number, false as private, false as loopback, split_part(source_ip, '.', 4)::int < 8 as in_net, concat(source_ip, '/32') as cidr from access group by source_ip",
    "event_indicators": f"with {INDICATED} select seq, {', '.join(IND)} from ind",
    "win_counters_10": counters(10), "win_counters_30": counters(30), "win_counters_60": counters(60),
    "distinct_bases": distinct_bases(),
    "ip_snapshot_ticks": f"with {TICKS} select tick, source_ip, {', '.join(IND)} from snap",
    "idle_sessions": f"""with {ACCESS}, x as (select *, case when ts - lag(ts) over (partition by source_ip order by ts, seq) >= 5 then 1 else 0 end as new from access),
      y as (select *, sum(new) over (partition by source_ip order by ts, seq rows unbounded preceding) as session from x) select source_ip, cast(session as bigint) as session, min(ts) as first, max(ts) as last, count(*) as n from y group by source_ip, session""",
    "port_scan": f"""with {ACCESS}, p as (select seq, source_ip as src_ip, cast(1 + seq * 7919 % 60 as int) as dst_port, ts from access),
      c as (select a.src_ip, a.ts, a.seq, a.dst_port, count(distinct case when b.ts > a.ts - 5 then b.dst_port end) as ports_5, count(distinct case when b.ts > a.ts - 30 then b.dst_port end) as ports_30, count(distinct b.dst_port) as ports_120
        from p a join p b on a.src_ip = b.src_ip and b.ts > a.ts - 120 and b.ts <= a.ts and b.seq <= a.seq group by all)
      select * exclude (k), 30::bigint as score from (select *, row_number() over (partition by src_ip order by ts, seq) as k from c where ports_5 > 5 or ports_30 > 15 or ports_120 > 40) where k = 1""",
    "buckets_5m": f"with {ACCESS} select cast(ts // 300 * 300 as bigint) as bucket, count(*) as total, count(*) filter (status = 404) as n404, count(*) filter (status in (401, 403)) as auth, count(*) filter (status in (401, 403, 400, 405, 408, 429, 422)) as n4xx, count(*) filter (status between 500 and 504) as n5xx from access group by 1",
    "ring512": f"with {RING} select source_ip, pos, seq, path, status from ring",
    "attacker_filter": f"with {TICKS} select source_ip, count(*) as ticks, count(*) filter ({ATTACK}) as dropped from snap group by source_ip",
    "percentiles": f"with {SAMPLES}, g as (select tick, dim, list_sort(list(value)) as l, count(*) as n from s group by tick, dim) select tick, dim, {PCT} from g",
    "mad_trim": f"""with {SAMPLES}, g as (select tick, dim, list_sort(list(value)) as l, count(*) as n from s group by tick, dim),
      m as (select *, list_extract(l, n // 2 + 1) as med from g), m2 as (select *, list_extract(list_sort(list_transform(l, lambda x: abs(x - med))), n // 2 + 1) as mad from m),
      k as (select tick, dim, case when n < 5 or mad <= 0 then l else list_filter(l, lambda x: x <= med + 5.0::double * mad) end as l from m2), h as (select *, len(l) as n from k) select tick, dim, {PCT} from h""",
    "p99_trim": f"""with {SAMPLES}, g as (select dim, list_sort(list(value)) as l, count(*) as n from s group by dim), m as (select *, list_extract(l, cast(floor(n * 0.99::double) as bigint) + 1) as p from g),
      k as (select dim, case when n < 5 or p <= 0 then l else list_filter(l, lambda x: x <= p) end as l from m), h as (select *, len(l) as n from k) select dim, {PCT} from h""",
    "baseline_decay": f"with recursive {folded()} select tick, dim, round(p50, 6) as p50, round(p95, 6) as p95, round(p99, 6) as p99, n from fold",
    "baseline_thresholds": f"""with recursive {folded()}, q as (select *, greatest(1.01::double, least(10.0::double, p95 / greatest(p50, 0.5::double))) as r from fold where dim = 'qps')
      select tick, {', '.join(f"round(case when n = 0 or p50 <= 0 then {wide} else least(greatest(r * {m}::double, {low}::double), 15.0::double) end, 6) as th{i}" for i, m, low, wide in ((1, 1.2, 1.5, 2), (2, 1.5, 2.0, 5), (3, 2.5, 3.0, 10)))},
        round(case when n = 0 or p95 <= 0 then 1.0::double else {least_rate('p95')} end, 6) as min_qps, round(case when n = 0 or p95 <= 0 then 0.3::double else greatest(p95 * 0.02::double, 0.05::double) end, 6) as guard_qps from q""",
    "asof_baseline": f"""with recursive {folded()} select a.seq, cast(a.ts // 10 * 10 as bigint) as tick, round(f.p50, 6) as p50, round(f.p95, 6) as p95, f.n from access a left join (select * from fold where dim = 'qps') f on f.tick = a.ts // 10 * 10""",
    "learnt_baseline": f"""with recursive {folded()}, ticks as (select tick, sum(n) as n, max(p95) filter (dim = 'qps') as qps, max(p95) filter (dim = 'r4xx') as r4xx from fold group by tick),
      x as (select a.seq, coalesce(b.n, 0) >= 100 and a.ts - {EPOCH} >= 300 as ready, b.* from (select *, ts // 10 * 10 as at from access) a asof left join ticks b on a.at >= b.tick)
      select seq, case when ready then 0.5::double else 0.0::double end as conf, round(case when ready then qps else 1000.0::double end, 6) as qps_p95, round(case when ready then r4xx else 1.0::double end, 6) as r4xx_p95, round(coalesce(qps, 0.0::double), 6) as own_qps_p95 from x""",
    "adaptive_lookback": f"with {LOOKBACK} select cast(minutes as bigint) as minutes, cutoff, median, buckets, healthy from look",
    "preload_baseline": f"""with {LOOKBACK}, good as (select b.*, b.total::double as t from buckets b, look where b.bucket >= look.cutoff and b.total >= look.median * 0.5::double),
      s as (""" + " union all ".join(f"select '{d}' as dim, {v} as value from good" for d, v in {"qps": "t / 300.0::double", "r4xx": "n4xx / t", "r5xx": "n5xx / t", "r404": "n404 / t", "auth": "auth / t"}.items()) + """),
      g as (select dim, list_sort(list(value)) as l from s group by dim), g2 as (select *, list_extract(l, cast(floor(len(l) * 0.99::double) as bigint) + 1) as top from g),
      k as (select dim, case when len(l) < 5 or top <= 0 then l else list_filter(l, lambda x: x <= 10.0::double * top) end as l from g2), k2 as (select *, list_extract(l, len(l) // 2 + 1) as med from k),
      k3 as (select *, list_extract(list_sort(list_transform(l, lambda x: abs(x - med))), len(l) // 2 + 1) as mad from k2),
      h as (select dim, case when dim <> 'qps' or len(l) < 5 or mad <= 0 then l else list_filter(l, lambda x: x <= med + 5.0::double * mad) end as l from k3),
      p as (select dim, len(l) as n, """ + ", ".join(f"list_extract(l, cast(floor(len(l) * {x}) as bigint) + 1) as {p}" for p, x in CENTILES.items()) + f""" from h),
      f as (select *, case when p95 <= 0 then 1.0::double else {least_rate('p95')} end as low from p)
      select dim, n, """ + ", ".join(f"round(case when dim = 'qps' and p95 < low then low * {m}::double else {p} end, 6) as {p}" for p, m in (("p50", 0.3), ("p95", 1), ("p99", 2))) + """ from f""",
    "stream_settings": f"""with {INDICATED}, e as (select min(ts) as lo, (max(ts) - min(ts)) // 3 + 1 as third from ind), x as (select *, (ts - lo) // third as batch from ind, e)
      select batch, count(*) as events, cast(sum(case when batch = 0 then sens when status >= 400 and list_has_any(string_split(lower({BARE}), '/'), ['orders', 'users']) then 1 else 0 end) as bigint) as sens,
        cast(sum(case when batch = 0 then bot when contains(user_agent, 'okhttp/4') or contains(user_agent, 'Nmap') then 1 else 0 end) as bigint) as bot from x group by batch""",
    "ip_diversity": f"""with {ACCESS}, c as (select source_ip, count(*) as n from access group by 1), t as (select *, row_number() over (order by n desc, source_ip) as k from c),
      r as (select count(*) as unique_ips, max(n)::double / sum(n) as a, sum(n) filter (k <= 3)::double / sum(n) as b from t) select unique_ips, round(a, 6) as top1_ratio, round(b, 6) as top3_ratio, unique_ips between 1 and 3 or (unique_ips between 4 and 10 and (a >= 0.9 or b >= 0.98)) as suspicious from r""",
    "prefix_runs": f"""with {RING}, x as (select *, {SEG} as seg from ring), y as (select *, case when seg = lag(seg) over (partition by source_ip order by pos) then 0 else 1 end as new from x),
      z as (select source_ip, seg, count(*) as n, sum(new) as s from y group by all) select source_ip, round(sum(n)::double / sum(s), 6) as avg_run, round(max(n)::double / sum(n), 6) as dominant from z group by source_ip""",
    "novelty": f"""with {RING}, t as (select source_ip, max(pos) as total, greatest(max(pos) // 3, 1) as k from ring group by 1), e as (select distinct r.source_ip, path from ring r join t using (source_ip) where pos <= k),
      p as (select source_ip, count(distinct path) as n from ring group by 1) select t.source_ip, round((select count(*) from e where e.source_ip = t.source_ip)::double / p.n, 6) as early,
      round((select count(*) from ring r where r.source_ip = t.source_ip and pos > total - k and not exists (select 1 from e where e.source_ip = r.source_ip and e.path = r.path))::double / k, 6) as late from t join p using (source_ip)""",
    "top5_cover": f"with {RING}, {TOP} select source_ip, round(sum(n)::double / (select count(*) from ring r where r.source_ip = top.source_ip), 6) as cover from top group by source_ip",
    "status_cv": f"""with {RING}, p as (select source_ip, path, status, count(*) as n from ring group by all), c as (select source_ip, path, sum(n) as n, coalesce(stddev_samp(n) / avg(n), 0) as cv from p group by all)
      select source_ip, round(coalesce(round(avg(cv) filter (n >= 3), 3), 0.0), 2) as cv from c group by source_ip""",
    "method_mix": f"""with {RING}, s as (select source_ip, avg(case when method = 'GET' then 1.0::double else 0 end) as g, avg(case when method = 'POST' then 1.0::double else 0 end) as p, avg(case when method not in ('GET', 'POST') then 1.0::double else 0 end) as u from ring group by 1)
      select source_ip, round(g, 6) as get, round(p, 6) as post, round(u, 6) as unusual, (g between 0.5 and 0.99 and p between 0.01 and 0.49 and u < 0.05) or (g >= 0.8 and u < 0.01) or (p >= 0.5 and g > 0.01 and u < 0.05) as method_ok from s""",
    "always_error": f"""with {RING}, {TOP} select source_ip, bool_or((regexp_matches({BARE}, '(?i)^/(favicon\\.ico|robots\\.txt|sitemap\\.xml|crossdomain\\.xml|\\.well-known/.*)$') and n >= 10 and least >= 400)
      or (not regexp_matches({BARE}, '(?i)^/(favicon\\.ico|robots\\.txt|sitemap\\.xml|crossdomain\\.xml|\\.well-known/.*)$') and not regexp_matches({BARE}, '(?i)\\.(css|js|mjs|png|jpe?g|gif|svg|ico|webp|woff2?|ttf|eot|otf|map)$') and n >= 5 and least >= 400)) as always_error from top group by source_ip""",
    "consistency_score": f"with {shape('{0}.pos = {0}.own')} select ip as source_ip, total, total >= 20 as has_samples, score, total >= 20 and score >= 4 as is_benign from s",
    "shape_as_of": f"with {shape('true')} select ev as seq, total, score, total >= 20 and score >= 4 as is_benign from s",
    "decide_all": f"with {DECIDED} select ip, cast(vote_count as int) as vote_count, cloud_score, cloud_confidence, effective_cloud, local_freq, detector, final_score, fast_path, case when final_score >= 80 then 'block' when final_score >= 50 then 'alert' else 'ignore' end as action from res",
    "score_range": f"with {DECIDED} select min(final_score) as least, max(final_score) as most from res",
    "consensus_fast_path": f"""with {ACCESS}, {INTEL}, x as (select ip, vote_count + 10 as vote_count, source from intel), y as (select *, {CONF} as conf, source = 'global' and vote_count >= 20 as fast_path from x),
      z as (select ip, fast_path, case when fast_path then 80.0::double else round(95.0::double * conf::double * 0.4::double + 15.0::double + 15.0::double, 6) end as final_score from y) select *, case when final_score >= 80 then 'block' when final_score >= 50 then 'alert' else 'ignore' end as action from z""",
    "ttl_active": f"with {ENTRIES} select ip, source, ttl, ts + ttl as expires_at from e, now where ts + ttl > now + 3000",
    "set_status": f"with {ENTRIES} select (select count(distinct source_ip) from access where status = 404) as blocked, 3::bigint as whitelisted, (select count(*) from e, now where ts + ttl > now + 3000) as with_ttl",
    "block_apply": f"""with {ACCESS}, k as (select distinct source_ip as ip from access where status = 500 and source_ip like '%5'), r as (select distinct source_ip as ip from access union select distinct concat(source_ip, 'x') from access)
      select ip, case when ip like '%x' then 'invalid' when {IN_NETS.format('ip')} and ip not like '%1' then 'whitelisted' when ip in (select ip from k) then 'exists' else 'blocked' end as outcome from r""",
    "unblock": f"""with {ACCESS}, k as (select distinct source_ip as ip from access where status = 500), a as (select distinct source_ip as ip from access where source = 'tomcat_access')
      select ip, case when ip in (select ip from k) then 'unblocked' else 'not blocked' end as outcome from a union all select ip, 'kept' from k where ip not in (select ip from a)""",
    "set_state": f"with {ACCESS}, {CHANGES}, l as (select set, ip, max_by(op, ord) as op from ch group by all) select set, ip, cast(3600 as int) as timeout from l where op = 'add'",
    "cloud_apply": f"""with {ACCESS}, {CHANGES}, l as (select set, ip, max_by(op, ord) as op from ch group by all), g as (select ip from l where set = 'white' and op = 'add')
      select set, ip, op from l where set = 'white' union all select 'black', coalesce(b.ip, g.ip), case when g.ip is not null then 'del' when {IN_NETS.format('b.ip')} and op = 'add' then 'filtered' else op end from (select * from l where set = 'black') b full join g on b.ip = g.ip""",
    "whitelist_sync": f"""with {ACCESS}, {NETS} select net, 'add' as op from nets union all select distinct source_ip, 'del' from access where source = 'apache_access' and source_ip not in (select net from nets)
      union all select distinct source_ip, 'unblock' from access where {IN_NETS.format('source_ip')}""",
    "diff_apply": f"""with {ACCESS}, {INTEL}, x as (select ip, -1 as seq, 'add' as op, score::double as score from intel union all select source_ip, seq, case when status = 404 then 'del' else 'add' end, (seq % 101)::double from access where seq > 500),
      l as (select ip, max_by(op, seq) as op, max_by(score, seq) as score from x group by ip) select ip, score from l where op = 'add'""",
    "set_table": f"""with {ACCESS}, x as (select seq, case when seq % 3 = 0 then 'white' else 'black' end as set, source_ip as ip, case when status = 302 then 'del' else 'add' end as op, case when seq % 2 = 0 then 'cloud' else 'local' end as source, ts, seq % 7 * 1500 as s from access),
      y as (select *, case when set = 'black' and op = 'add' then ts + case when source = 'cloud' then case when s = 0 then 7200 else least(s, 7200) end else case when s = 0 then 3600 else s end end end as e from x),
      l as (select set, ip, arg_max(op, seq) as op, arg_max(source, seq) as source, max(seq) as seq from y group by all), n as (select max(ts) as now from access)
      select l.set, l.ip, l.source, cast(coalesce(y.e, -1) as bigint) as expires_at from l join y using (seq), n where l.op = 'add' and (y.e is null or y.e > now + 2000)""",
    "layered_intel": f"""with {INDICATED}, now as (select max(ts) as now from access), f as (
        select 'global' as layer, -1 as seq, ip, 6.0 * n as score, n as votes, 'global' as source from (select distinct source_ip as ip, cast(split_part(source_ip, '.', 4) as int) as n from access)
        union all select 'global', seq, source_ip, (seq % 101)::double, seq % 25, 'global' from access where status = 404 and seq > 400
        union all select 'tenant', seq, source_ip, (seq * 7 % 101)::double, seq % 25, 'private' from access where status = 500 and seq > 200),
      k as (select * from (select *, row_number() over (partition by ip order by layer desc, seq desc) as r from f) where r = 1),
      c as (select *, {CONF.replace('vote_count', 'votes')} as conf, source = 'global' and votes >= 20 and score >= 90 as fast from k),
      l as (select source_ip as ip, least(sum(c4xx) % 101, 100) as freq, least(sum(sens), 100) as detector, max(ts) as last_seen from ind group by 1),
      d as (select c.*, case when fast then 80.0::double else round(score::double * conf::double * 0.4::double + coalesce(m.freq, 50)::double * 0.3::double + coalesce(m.detector, 50)::double * 0.3::double, 6) end as final_score from c left join (select l.* from l, now where last_seen >= now - 60) m using (ip)),
      w as (select source_ip as ip, arg_max(case when seq % 2 = 0 then 'add' else 'del' end, seq) as op from access where status = 403 and seq > 200 group by 1)
      select ip, layer, score::double as cloud_score, final_score, case when final_score >= 80 then case when ip in (select ip from w where op = 'add') then 'filtered' else 'block' end when final_score >= 50 then 'alert' else 'ignore' end as action from d
      union all select ip, 'tenant', null, null, concat('white_', op) from w""",
    "logged_report": f"""with {JUDGED} select cast(ts // 600 * 600 as bigint) as period, count(*) as processed, count(*) filter (final >= 10) as total, count(distinct source_ip) filter (final >= 10) as ips,
        count(*) filter (final >= 10 and is_high) as high, count(*) filter (final >= 10 and not is_high) as medium from j group by 1""",
    "detector_report": f"""with {JUDGED} select cast(ts // 600 * 600 as bigint) as period, count(*) as processed, count(*) filter (final > 0) as scored, count(distinct source_ip) as ips, count(*) filter (is_high) as high, count(*) filter (final > 0 and not is_high) as medium,
      count(*) filter (final <= 0) as low, count(*) filter (status // 100 = 2) as s2xx, count(*) filter (status // 100 = 3) as s3xx, count(*) filter (status // 100 = 4) as s4xx, count(*) filter (status // 100 = 5) as s5xx from j group by 1""",
    "per_source": f"with {ACCESS} select source, cast(status // 100 as bigint) as status_class, count(*) as n from access group by rollup (source, status_class)",
    "blocked_rollup": f"with {JUDGED} select source_ip, count(*) as n, max(final) as max_score, max_by(ts, seq) as last_ts, array_to_string(list_sort(list(distinct source)), ',') as sources from j where is_high group by source_ip",
    "top_blocked": f"with {JUDGED} select source_ip, count(*) as n, max(final) as max_score, max_by(ts, seq) as last_ts, array_to_string(list_sort(list(distinct source)), ',') as sources from j where final > 0 group by source_ip order by n desc, source_ip limit 10",
    "sampled": f"with {JUDGED} select seq, source_ip, final from j where seq % 10 = 0 order by seq desc limit 1000",
    "max_score_payload": f"with {JUDGED} select source_ip, final as score, seq, ts, path from (select *, row_number() over (partition by source_ip order by final desc, seq) as k from j) where k = 1",
    "feature_stats": f"""with {JUDGED}, x as (select 'path' as dim, path as value, is_high from j union all select 'user_agent', user_agent, is_high from j union all select 'method', method, is_high from j union all select 'status', cast(status as varchar), is_high from j),
      g as (select dim, value, count(*) as hits, count(*) filter (is_high) as high, count(*) filter (not is_high) as low from x group by all) select * from (select *, row_number() over (partition by dim order by hits desc, value) as rank from g) where rank <= 20""",
    "feature_sketches": f"""with {JUDGED}, x as (select 'path' as dim, path as value from j union all select 'user_agent', user_agent from j union all select 'method', method from j union all select 'status', cast(status as varchar) from j),
      g as (select dim, value, count(*) as hits from x group by all) select * from (select *, row_number() over (partition by dim order by hits desc, value) as rank from g) where rank <= 20""",
    "dimension_hits": f"""with {JUDGED}, w as (select j.*, {', '.join(f"{n} > 0 or sum({n}) over (partition by source_ip order by ts, seq rows unbounded preceding) - coalesce(sum({n}) over (partition by source_ip order by ts range between unbounded preceding and 60 preceding), 0) > 0 as h_{n}" for n in ('sens', 'bot', 'empty_ref', 'dmethod', 'c401'))} from j)
      select cast(ts // 600 * 600 as bigint) as period, count(*) as total, count(*) filter (source = 'nginx_access') as from_nginx, count(*) filter (source = 'apache_access') as from_apache, count(*) filter (source = 'tomcat_access') as from_tomcat, 0::bigint as from_linux,
        count(*) filter (h_sens) as sensitive_path_hits, count(*) filter (h_bot) as bot_ua_hits, count(*) filter (h_empty_ref) as empty_referer_hits, count(*) filter (h_dmethod) as dangerous_method_hits, count(*) filter (h_c401) as auth_fail_hits from w where final >= 10 group by 1""",
    "digest": f"""with {JUDGED}, m as (select source_ip as ip, final as score, ts from (select *, row_number() over (partition by source_ip order by final desc, seq) as k from j) where k = 1)
      select sha256(concat(string_agg(concat(ip, '|', score, '|', ts), ';' order by ip, ts), 'suffix')) as digest from m""",
    "distinct_counts": f"with {ACCESS} select count(distinct source_ip) as n_source_ip, count(distinct path) as n_path, count(distinct user_agent) as n_user_agent from access",
    "feature_merge": f"""with {ACCESS}, x as (select distinct path as item, 1 as rank, 'builtin' as source from access where source_ip like '%.15' union select path, 2, 'cloud' from access where status = 404 union select path, 3, 'local' from access where status = 500)
      select item, string_agg(source, '+' order by rank) as sources from x where item not like '/static%' group by item""",
    "feature_caps": f"""with {ACCESS}, x as (select seq, case when seq % 3 = 0 then 'ua' else 'path' end as category, concat(path, seq % 50) as value from access), y as (select *, row_number() over (partition by category order by seq) as k from x),
      z as (select category, list_sort(list(distinct value)) as l from y where k <= case category when 'ua' then 200 else 500 end group by category) select category, len(l) as n, array_to_string(l[1:5], ',') as head from z""",
    "ip_risk_report": f"""with {INDICATED}, w as (select source_ip, """ + ", ".join(f"sum({n}) over (partition by source_ip order by ts, seq rows unbounded preceding) - coalesce(sum({n}) over (partition by source_ip order by ts range between unbounded preceding and 60 preceding), 0) as {n}" for n in ("total", "c404", "c4xx", "sens", "danger", "bot")) + """ from ind)
      select source_ip, cast(max(sens * 3 + danger * 5 + bot + c4xx + c404) as bigint) as risk, cast(max(total) as bigint) as peak, count(*) as events from w group by source_ip order by risk desc, source_ip limit 10""",
}
ORACLES["stream_port_scan"] = ORACLES["port_scan"]
ORACLES["stream_snapshots"] = ORACLES["ip_snapshot_ticks"]
ORACLES["stream_baseline"] = ORACLES["baseline_decay"]
