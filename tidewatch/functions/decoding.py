"""Decoding, path cleaning, body scans and address checks that built-in expressions cannot express.

All are Arrow-batched; each batch decodes a distinct text once.
"""

from __future__ import annotations

import ipaddress
import json
import posixpath
import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import features
from . import scalars as S

_BAD_ESCAPE = re.compile("%(?![0-9a-fA-F]{2})")
_UNICODE, _HEX, _ENTITY = re.compile(r"\\[uU]([0-9a-fA-F]{4})"), re.compile(r"\\x([0-9a-fA-F]{2})"), re.compile(r"&#(x[0-9a-fA-F]+|[0-9]+);|&([a-zA-Z]+);")
# Named entities that are decoded.
NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "nbsp": " ", "slash": "/", "backslash": "\\"}
_CLIMB = re.compile(r"(^|[/\\])\.\.([/\\]|$)")


def _url(s: str, plus: bool) -> str:
    """Percent decoding that leaves the whole text alone if one escape is bad."""
    if _BAD_ESCAPE.search(s):
        return s
    return unquote_to_bytes(s.replace("+", " ") if plus else s).decode("utf-8", "replace")


def _char(n: int, else_: str) -> str:
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else else_


def _entity(m: re.Match) -> str:
    """Numbers of more than seven digits name no character, however long they are."""
    if m[2]:
        return NAMED.get(m[2], m[0])
    digits, base = (m[1][1:], 16) if m[1][0] == "x" else (m[1], 10)
    digits = digits.lstrip("0") or "0"
    return _char(int(digits, base), m[0]) if len(digits) <= 7 else m[0]


def _hex(m: re.Match) -> str:
    """Printable Latin-1 only."""
    n = int(m[1], 16)
    return chr(n) if 0x20 <= n < 0x7F or n > 0xA0 and n != 0xAD else m[0]


def decode_once(s: str) -> str:
    """percent twice (the second time with + as a space), then \\u or \\U, \\x and entities, each in one pass."""
    s = _url(_url(s, False), True)
    s = _UNICODE.sub(lambda m: _char(int(m[1], 16), m[0]), s)
    return _ENTITY.sub(_entity, _HEX.sub(_hex, s))


def decode(s: str, rounds: int = 3) -> str:
    """up to three rounds, or until nothing changes."""
    for _ in range(rounds):
        new = decode_once(s)
        if new == s:
            break
        s = new
    return s


def climbs(s: str) -> bool:
    """a parent step in the text or in one of four decodings of it."""
    for _ in range(5):
        if _CLIMB.search(s) or "%2e%2e" in s.lower():
            return True
        new = decode_once(s)
        if new == s:
            return False
        s = new
    return False


def clean_path(s: str) -> str:
    """F6 without the flag: no query, decoded, slashes straight, cleaned, a final slash kept."""
    p = decode(s.split("?", 1)[0]).replace("\\", "/")
    if not p:
        return "/"
    out = posixpath.normpath(p)
    out = "/" + out.lstrip("/") if p.startswith("/") else out
    return out + "/" if p.endswith("/") and out != "/" else out


def _each(values: pd.Series, f) -> pd.Series:
    v = values.fillna("")
    return v.map({x: f(x) for x in v.unique()})


def _mapped(f, kind: str) -> Callable[[Column], Column]:
    """A function of one text column, run over Arrow batches."""

    def run(s: pd.Series) -> pd.Series:
        return _each(s, f)

    return lambda c: F.pandas_udf(run, kind)(c)


def _is_network(x: str) -> bool:
    try:
        ipaddress.ip_network(x, strict=False)
        return True
    except ValueError:
        return False


decode_path = _mapped(decode, "string")
has_traversal = _mapped(climbs, "boolean")
valid_ip = _mapped(_is_network, "boolean")  # P15


def _normalized(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"path": _each(s, clean_path), "traversal": _each(s, climbs)})


def normalize_request_path(c: Column) -> Column:
    """struct of the cleaned path and whether it climbs."""
    return F.pandas_udf(_normalized, "struct<path:string,traversal:boolean>")(c)


def in_networks(nets: Sequence[str]) -> Callable[[Column], Column]:
    """A pandas UDF for membership in IPv4 or IPv6 networks; IPv4 alone is cheaper by scalars.in_cidr."""
    parsed = [ipaddress.ip_network(n, strict=False) for n in nets]

    def test(s: pd.Series) -> pd.Series:
        def inside(x: str) -> bool:
            try:
                a = ipaddress.ip_address(x)
            except ValueError:
                return False
            return any(a in n for n in parsed if a.version == n.version)

        return _each(s, inside)

    return lambda c: F.pandas_udf(test, "boolean")(c)


def _strings(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [t for v in value.values() for t in _strings(v)]
    if isinstance(value, list):
        return [t for v in value for t in _strings(v)]
    return []


def _hits(texts: list[str], patterns: Sequence[str]) -> int:
    """for each text, the patterns that it holds after its good percent escapes are decoded."""
    low = [(unquote_to_bytes(t).decode("utf-8", "replace") if "%" in t else t).lower() for t in texts]
    return sum(p.lower() in t for t in low for p in patterns if p)


def _not_a_number(name: str) -> None:
    raise ValueError(name)


def _form_values(body: str) -> list[str] | None:
    """The decoded values of a form, or None if it is no good one: a bad escape or a semicolon anywhere."""
    out = []
    for pair in filter(None, body.split("&")):
        if ";" in pair or _BAD_ESCAPE.search(pair):
            return None
        out.append(_url(pair.partition("=")[2], True))
    return out


def _base_type(kind: str) -> str:
    return kind.split(";", 1)[0].strip().lower()


def scan_text(kind: str, body: str, patterns: Sequence[str], most: int | None) -> int:
    """Hits added up over the string values of JSON or the values of a form; other bodies, multipart ones that
    do not parse as a form among them, and what does not parse are searched as a whole. An external entity in XML is a hit too.
    """
    kind = _base_type(kind)
    if not body or kind not in features.BODY_TYPES:
        return 0
    raw, values = cut(body, most), None
    if "json" in kind:
        try:
            values = _strings(json.loads(raw, parse_constant=_not_a_number))
        except (ValueError, RecursionError):
            values = None
    elif "form" in kind:
        values = _form_values(raw)
    return _hits([raw] if values is None else values, patterns) + holds_xxe(kind, raw)


def cut(body: str, most: int | None) -> str:
    """The first `most` bytes of a body (None: all)."""
    return body if most is None else body.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")


def holds_xxe(kind: str, raw: str) -> bool:
    """F20."""
    low = raw.lower()
    return "xml" in kind and "<!doctype" in low and "entity" in low


def body_scan(kind: Column, body: Column, patterns: Sequence[str] = features.DANGEROUS_PATTERNS, most: int | None = 10_240) -> Column:
    """struct of body_hits and xxe; bodies of other types are not scanned. Both are looked for in the first `most` bytes (None: in all)."""

    def scan(k: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(x or "", y or "") for x, y in zip(k, b)]
        return pd.DataFrame({
            "body_hits": [scan_text(x, y, patterns, most) for x, y in rows],
            "xxe": [_base_type(x) in features.BODY_TYPES and holds_xxe(_base_type(x), cut(y, most)) for x, y in rows],
        })

    return F.pandas_udf(scan, "struct<body_hits:bigint,xxe:boolean>")(kind, body)


def _bits(x: str) -> str | None:
    try:
        a = ipaddress.ip_address(x)
    except ValueError:
        return None
    return format(int(a), "0128b") if a.version == 6 else None


def ipv6_bits(ip: Column) -> Column:
    """The 128 bits of an IPv6 address as text, null for any other text."""
    return _mapped(_bits, "string")(ip)


def _looked_at(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"path": _each(s, clean_path), "text": _each(s, decode), "traversal": _each(s, climbs)})


def looked_at(path: Column) -> Column:
    """Struct of the cleaned path (F6), the decoded text (F4) and whether it climbs (F5); only texts that decoding or cleaning can change go to Python."""
    odd = path.rlike(r"[%+\\&]|//|/\.|^\.") | ~path.startswith("/")
    seen = F.pandas_udf(_looked_at, "struct<path:string,text:string,traversal:boolean>")(F.when(odd, path))
    plain = F.struct(F.substring_index(path, "?", 1).alias("path"), path.alias("text"), F.lit(False).alias("traversal"))
    return F.when(odd | path.isNull(), seen).otherwise(plain)
