"""URLs as column expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_scheme(target: Column | str) -> Column:
    return _c(target).rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:")


def link_class(target: Column | str) -> Column:
    """``self``, ``external``, ``absolute`` or ``relative``."""
    t = _c(target)
    return F.when(t.startswith("#"), "self").when(has_scheme(t) | t.startswith("//"), "external").when(t.startswith("/"), "absolute").otherwise("relative")


def valid_url(url: Column | str) -> Column:
    """https, with a host and without user or fragment; a port must be 1 to 65535."""
    u = _c(url)
    host = F.try_parse_url(u, F.lit("HOST"))
    authority = F.try_parse_url(u, F.lit("AUTHORITY"))
    port = F.regexp_extract(authority, r":(\d+)\z", 1)
    number = port.try_cast("int")
    ok_port = ~authority.rlike(r":\d*\z") | number.between(1, 65535)
    return F.coalesce(F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).eqNullSafe("https") & host.isNotNull() & F.try_parse_url(u, F.lit("USERINFO")).isNull() & ~u.contains("#") & ok_port, F.lit(False))


def canonical_url(url: Column | str) -> Column:
    """Scheme and host in lower case, an empty path as ``/``, no fragment; NULL if not a URL."""
    u = F.regexp_replace(_c(url), r"#[\s\S]*\z", "")
    head = F.lower(F.regexp_extract(u, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)", 1))
    rest = F.regexp_replace(u, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?]+", "")
    return F.when(head != "", F.concat(head, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def relevant_link(url: Column | str) -> Column:
    """A valid URL of a page: a folder, a manifest, or a file with no or a text extension."""
    path = F.lower(F.coalesce(F.try_parse_url(_c(url), F.lit("PATH")), F.lit("")))
    ext = F.regexp_extract(path, r"(\.[^./]*)\z", 1)
    return valid_url(url) & (path.endswith("/") | path.endswith("/llms.txt") | ext.isin("", ".md", ".markdown", ".html", ".htm", ".json"))


def link_label(title: Column | str) -> Column:
    """A title as the label of a Markdown link."""
    return F.regexp_replace(_c(title), r"([\\\[\]])", r"\\$1")


# Characters that stay as they are in a link's destination.
PLAIN_IN_PATHS = "/$&+,:;=@~!'"


def link_target(path: Column | str) -> Column:
    """A path as the destination of a Markdown link, percent-encoded where need be."""
    out = F.replace(F.url_encode(_c(path)), F.lit("+"), F.lit("%20"))
    for c in PLAIN_IN_PATHS:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def publication_base(url: Column | str) -> Column:
    """The folder of a published file: everything up to the last slash."""
    return F.regexp_replace(canonical_url(url), r"[^/]*(?:\?[\s\S]*)?\z", "")


def in_scope(url: Column | str, base: Column | str) -> Column:
    return canonical_url(url).startswith(_c(base))


# Networks that are not public.
BLOCKED = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
    "::/128",
    "::1/128",
    "fc00::/7",
    "fe80::/10",
    "2001:db8::/32",
    "2001:10::/28",
    "64:ff9b::/96",
    "64:ff9b:1::/48",
)
_NETWORKS = [ipaddress.ip_network(x) for x in BLOCKED]


def public_address(text: str | None) -> bool | None:
    """Whether an address may be reached from outside; what is no address is not public."""
    if text is None:
        return None
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return False
    a = getattr(a, "ipv4_mapped", None) or a
    return not (a.is_multicast or any(a in n for n in _NETWORKS if n.version == a.version))


@F.pandas_udf(T.BooleanType())
def is_public_ip(ip: pd.Series) -> pd.Series:
    return ip.map(public_address)
