"""URL functions: column expressions for what a pattern can do, a resolver for the rest."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Public suffixes of two labels; all others count as one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "co.in", "com.mx", "co.za", "com.tr", "com.cn")
SANITIZE = r"((?:(?:https?|ftp|mailto)://|mailto:)[^\s<>\"]+)"


def part(url: Column, which: str) -> Column:
    """scheme, host, path, query or fragment; null where absent."""
    patterns = {
        "scheme": (r"^([A-Za-z][A-Za-z0-9+.-]*):", 1),
        "host": (r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1),
        "path": (r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1),
        "query": (r"^[^?#]*\?([^#]*)", 1),
        "fragment": (r"#(.*)$", 1),
    }
    pattern, group = patterns[which]
    value = F.regexp_extract(url, pattern, group)
    if which in ("scheme", "host"):
        value = F.lower(value)
    return F.when(F.regexp_like(url, F.lit(pattern)), value)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(part(url, "path"), F.lit("")), "/"), lambda s: s != "")


def domain(url: Column) -> Column:
    """Registrable domain; an address is its own."""
    host = part(url, "host")
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    three = F.array_join(F.slice(labels, -3, 3), ".")
    return (
        F.when(F.regexp_like(host, F.lit(r"^[0-9.]+$")) | (F.size(labels) < 2), host)
        .when(two.isin(*TWO_LABEL_SUFFIXES) & (F.size(labels) > 2), three)
        .otherwise(two)
    )


def query_values(url: Column) -> Column:
    """Names and values of the query as a map; the last of equal names wins."""
    pairs = F.filter(F.split(F.coalesce(part(url, "query"), F.lit("")), "&"), lambda p: p != "")
    entries = F.transform(pairs, lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)), F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1))))
    folded = F.aggregate(
        entries,
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["col1"]), F.map_from_arrays(F.array(e["col1"]), F.array(e["col2"]))),
    )
    return folded


def titleized(url: Column) -> Column:
    """Words of the path with capitals, the last extension dropped."""
    cleaned = F.transform(path_segments(url), lambda s: F.trim(F.regexp_replace(s, "[^A-Za-z0-9.]+", " ")))
    words = F.regexp_replace(F.array_join(F.filter(cleaned, lambda s: s != ""), " "), r"\.[A-Za-z0-9]+$", "")
    return F.initcap(words)


def channel_titleized(url: Column) -> Column:
    """``host: Seg Seg``, or the host."""
    segments = F.transform(path_segments(url), lambda s: F.initcap(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))
    return F.when(F.size(segments) > 0, F.concat(part(url, "host"), F.lit(": "), F.array_join(segments, " "))).otherwise(part(url, "host"))


def with_query_value(url: Column, name: str, value: Column) -> Column:
    """The URL with one query value set; other values keep their order, the fragment stays."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    kept = F.filter(F.split(F.coalesce(part(url, "query"), F.lit("")), "&"), lambda p: (p != "") & (F.regexp_extract(p, "^([^=]*)", 1) != name))
    pairs = F.concat(kept, F.array(F.concat(F.lit(f"{name}="), value.cast("string"))))
    tail = F.when(part(url, "fragment").isNotNull(), F.concat(F.lit("#"), part(url, "fragment"))).otherwise("")
    return F.concat(base, F.lit("?"), F.array_join(pairs, "&"), tail)


def valid_channel(url: Column) -> Column:
    """Absolute http(s), no user info, no @ in query or fragment."""
    late = F.concat(F.coalesce(part(url, "query"), F.lit("")), F.coalesce(part(url, "fragment"), F.lit("")))
    return F.coalesce(part(url, "scheme").isin("http", "https") & (part(url, "host") != "") & ~F.regexp_like(url, F.lit(r"^[a-z]+://[^/?#]*@")) & (F.instr(late, "@") == 0), F.lit(False))


def sanitize(raw: Column) -> Column:
    """The first absolute URL in a text, in normal form; null without one."""
    found = F.regexp_extract(raw, SANITIZE, 1)
    return normalize_url(F.when(found != "", found))


@lru_cache(65536)
def normalized(url: str) -> str:
    """Lower-case scheme and host, no default port, dot segments gone, unsafe characters escaped, ``/`` for an empty path."""
    s = urlsplit(url.strip())
    netloc = s.netloc
    if netloc:
        user, at, host = netloc.rpartition("@")
        host = host.lower()
        if (s.scheme, host[host.rfind(":") :]) in (("http", ":80"), ("https", ":443")):
            host = host[: host.rfind(":")]
        netloc = user + at + host
    safe = "%/:=&?~#+!$,;'@()*[]-._"
    path = urlsplit(urljoin("http://x/", s.path)).path if s.path.startswith("/") else s.path
    return urlunsplit((s.scheme.lower(), netloc, quote(path or ("/" if netloc else ""), safe=safe), quote(s.query, safe=safe), quote(s.fragment, safe=safe)))


@lru_cache(65536)
def resolved(relative: str, base: str) -> str | None:
    """An absolute URL stays; others join the base in normal form; null where that fails."""
    relative = relative.strip()
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", relative):
        return relative
    try:
        return normalized(urljoin(base, relative))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolve_url(relative: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or b is None else resolved(r, b) for r, b in zip(relative, base, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def normalize_url(url: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else normalized(u) for u in url], dtype=object)


def resolve(relative: Column, base: Column) -> Column:
    """from-relative with a column path for the two plain shapes, the Python resolver for the rest."""
    plain = F.regexp_like(relative, F.lit("^/[A-Za-z0-9._~/-]*$")) & ~F.regexp_like(relative, F.lit(r"//|/\.{1,2}(/|$)"))
    joined = F.concat(F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#:@]*)(?:[/?#]|$)", 1)), relative)
    quick = plain & F.regexp_like(base, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:@]+([/?#]|$)"))
    return F.when(F.regexp_like(relative, F.lit("^https?:")), relative).when(quick, joined).otherwise(resolve_url(relative, base))
