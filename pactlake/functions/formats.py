"""Format predicates: each as a Python function of a string and, where it can be, as a Column.

All hold for values that are no strings.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from datetime import date as _Date
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlake.functions import patterns

_TIME = re.compile(r"(\d{2}):(\d{2}):(\d{2})(\.\d+)?([Zz]|([+-])(\d{2}):(\d{2}))", re.ASCII)
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", re.ASCII)
_POINTER = re.compile(r"(/([^~/]|~[01])*)*", re.DOTALL)
_RELATIVE = re.compile(r"(0|[1-9]\d*)(#|(/([^~/]|~[01])*)*)", re.ASCII | re.DOTALL)
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = re.compile(rf"{_OCTET}(\.{_OCTET}){{3}}", re.ASCII)
_DURATION = re.compile(r"P(\d+W|(?=.)(\d+Y(\d+M(\d+D)?)?|\d+M(\d+D)?|\d+D)?(T(?=\d)(\d+H(\d+M(\d+S)?)?|\d+M(\d+S)?|\d+S))?)", re.ASCII)
_ATEXT = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-\u0080-\U0010ffff]+"
_LOCAL = re.compile(rf'{_ATEXT}(\.{_ATEXT})*|"([^"\\\r\n]|\\[^\r\n])*"')


def date(s: str) -> bool:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", s, re.ASCII) or s[:4] == "0000":
        return False
    try:
        return bool(_Date.fromisoformat(s))
    except ValueError:
        return False


def time(s: str) -> bool:
    if not (m := _TIME.fullmatch(s)):
        return False
    h, mi, sec = (int(m[k]) for k in (1, 2, 3))
    oh, om = int(m[7] or 0), int(m[8] or 0)
    if h > 23 or mi > 59 or sec > 60 or oh > 23 or om > 59:
        return False
    offset = (oh * 60 + om) * (-1 if m[6] == "-" else 1)
    return sec < 60 or (h * 60 + mi - offset) % 1440 == 1439


def date_time(s: str) -> bool:
    return len(s) >= 20 and s[10] in "Tt" and date(s[:10]) and time(s[11:])


def duration(s: str) -> bool:
    return bool(_DURATION.fullmatch(s))


def period(s: str) -> bool:
    start, slash, end = s.partition("/")
    if not slash or "/" in end:
        return False
    if start[:1] == "P":
        return duration(start) and date_time(end)
    return date_time(start) and (date_time(end) or duration(end))


def hostname(s: str) -> bool:
    s = s.removesuffix(".")
    if not 0 < len(s) <= 253 or s[0] == "-":
        return False
    return all(1 <= len(x) <= 63 and x[-1] != "-" and re.fullmatch(r"[A-Za-z0-9-]+", x) for x in s.split("."))


def ipv4(s: str) -> bool:
    return bool(_IPV4.fullmatch(s))


def ipv6(s: str) -> bool:
    if ":" not in s or "%" in s:
        return False
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def email(s: str) -> bool:
    if len(s) > 254:
        return False
    local, at, domain = s.rpartition("@")
    if not at or not 0 < len(local) <= 64 or not _LOCAL.fullmatch(local):
        return False
    if domain.startswith("[") and domain.endswith("]"):
        inner = domain[1:-1]
        return ipv6(inner[5:]) if inner.startswith("IPv6:") else ipv4(inner)
    return hostname(domain)


def _parses(s: str) -> bool:
    if re.search(r"[\x00-\x20\x7f]", s) or re.search(r"%(?![0-9A-Fa-f]{2})", s):
        return False
    try:
        parts = urlsplit(s)
        _ = parts.port
    except ValueError:
        return False
    if re.search(r'[<>"{}|^`\\]', parts.netloc):
        return False
    if (host := parts.netloc.rpartition("@")[2]).count(":") > 1 and not host.startswith("["):
        return False
    first = s.split("/", 1)[0].split("?", 1)[0].split("#", 1)[0]
    return ":" not in first or bool(re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", s))


def uri(s: str) -> bool:
    return _parses(s) and bool(re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", s)) and not re.search(r'[<>"{}|^`\\]', s)


def iri(s: str) -> bool:
    return uri(s)


def uri_reference(s: str) -> bool:
    return "\\" not in s and _parses(s)


def uri_template(s: str) -> bool:
    depth = 0
    for c in s:
        depth += (c == "{") - (c == "}")
        if depth not in (0, 1):
            return False
    return not depth and _parses(re.sub(r"[{}]", "", s))


def json_pointer(s: str) -> bool:
    return bool(_POINTER.fullmatch(s))


def relative_json_pointer(s: str) -> bool:
    return bool(_RELATIVE.fullmatch(s))


def uuid(s: str) -> bool:
    return bool(_UUID.fullmatch(s))


def is_regex(s: str) -> bool:
    try:
        return bool(patterns.compiled(s))
    except patterns.InvalidPattern:
        return False


FORMATS: dict[str, Callable[[str], bool]] = {
    "date-time": date_time, "date": date, "time": time, "duration": duration, "period": period, "hostname": hostname, "email": email,
    "ip-address": ipv4, "ipv4": ipv4, "ipv6": ipv6, "uri": uri, "iri": iri, "uri-reference": uri_reference, "uriref": uri_reference,
    "iri-reference": uri_reference, "uri-template": uri_template, "json-pointer": json_pointer, "relative-json-pointer": relative_json_pointer,
    "uuid": uuid, "regex": is_regex, "unknown": lambda s: True,
}


def _date_column(s: Column) -> Column:
    return s.rlike(r"^\d{4}-\d{2}-\d{2}\z") & ~s.startswith("0000") & s.try_cast("date").isNotNull()


def _time_column(s: Column) -> Column:
    part = lambda a, n: F.substring(s, a, n).try_cast("int")
    shaped = s.rlike(r"^([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)\z")
    zulu = s.rlike("[Zz]\\z")
    size = F.char_length(s)
    sign = F.when(F.substring(s, -6, 1) == "-", -1).otherwise(1)
    offset = F.when(zulu, 0).otherwise(sign * (F.substring(s, -5, 2).try_cast("int") * 60 + F.substring(s, -2, 2).try_cast("int")))
    utc = F.pmod(part(1, 2) * 60 + part(4, 2) - offset, F.lit(1440))
    return shaped & (size >= 9) & F.coalesce((part(7, 2) < 60) | (utc == 1439), F.lit(False))


_JAVA = lambda p: f"^(?:{p.pattern})\\z"

#: The same predicates as Column functions, where built-in functions express them whole.
COLUMNS: dict[str, Callable[[Column], Column]] = {
    "date": _date_column,
    "time": _time_column,
    "date-time": lambda s: (F.char_length(s) >= 20) & F.substring(s, 11, 1).isin("T", "t") & _date_column(F.substring(s, 1, 10)) & _time_column(F.substr(s, F.lit(12))),
    "duration": lambda s: s.rlike(_JAVA(_DURATION)),
    "ipv4": lambda s: s.rlike(_JAVA(_IPV4)),
    "ip-address": lambda s: s.rlike(_JAVA(_IPV4)),
    "hostname": lambda s: _hostname_column(F.regexp_replace(s, r"\.\z", "")),
    "json-pointer": lambda s: s.rlike(r"(?s)^(/([^~/]|~[01])*)*\z"),
    "relative-json-pointer": lambda s: s.rlike(r"(?s)^(0|[1-9]\d*)(#|(/([^~/]|~[01])*)*)\z"),
    "uuid": lambda s: s.rlike(_JAVA(_UUID)),
    "unknown": lambda s: F.lit(True),
}


def _hostname_column(s: Column) -> Column:
    return (F.char_length(s) <= 253) & s.rlike(r"^(?!-)[A-Za-z0-9-]{0,62}[A-Za-z0-9](\.[A-Za-z0-9-]{0,62}[A-Za-z0-9])*\z")
