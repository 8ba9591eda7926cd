"""Request policy as columns: which URLs may be requested, given the page they come from and the addresses they resolve to.

Name resolution happens outside: a guard takes the resolved addresses as an array column, so that a stored crawl can be
judged again at any time. All tests are column expressions; IPv4 ranges are integer intervals.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweave.functions import texts, urls

#: Names and address ranges that are never requested.
LOCAL_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal")
BLOCKED_V4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4")
BLOCKED_V6 = ("::/128", "::1/128", "fe80::/10", "fc00::/7", "ff00::/8")
MAX_REQUESTS_CEILING = 10
_OCTET = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def v4_number(address: Column) -> Column:
    """An IPv4 address as a number; null for other text."""
    parts = [F.regexp_extract(address, _V4, k).try_cast("long") for k in range(1, 5)]
    return ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]


def _v6_blocked(address: Column) -> Column:
    """By the first group (fe80-febf, fc00-fdff, ff00-ffff), or all zero but for a last 0 or 1."""
    text = F.lower(address)
    zero = F.regexp_like(text, F.lit(r"^[0:]*:0{0,3}[01]?$"))
    return zero | F.regexp_like(text, F.lit(r"^(fe[89ab][0-9a-f]|f[cdf][0-9a-f]{2}):"))


def is_address(x: Column) -> Column:
    return v4_number(x).isNotNull() | F.contains(x, F.lit(":"))


def blocked_address(address: Column) -> Column:
    """Private, loopback, link-local, multicast and unspecified addresses; null and unreadable ones are blocked too."""

    def judged(number: Column) -> Column:
        inside = F.lit(False)
        for net in map(ipaddress.ip_network, BLOCKED_V4):
            inside = inside | number.between(int(net.network_address), int(net.broadcast_address))
        return F.when(number.isNotNull(), inside).when(F.contains(address, F.lit(":")), _v6_blocked(address)).otherwise(F.lit(True))

    return texts.let(v4_number(address), judged)


def private_target(url: Column, addresses: Column | None = None) -> Column:
    """Whether the guard denies a URL: a local name, a blocked literal address, or names with no or any blocked address.

    Without an addresses column names count as public unless they are local.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), r"[\[\]]", "")
    named = F.lit(False) if addresses is None else F.coalesce(F.size(addresses) <= 0, F.lit(True)) | F.exists(addresses, blocked_address)

    def judged(h: Column) -> Column:
        return F.when(h.isNull() | (h == "") | h.isin(*LOCAL_HOSTS), True).when(is_address(h), blocked_address(h)).otherwise(named)

    return texts.let(host, judged)


def _port(url: Column) -> Column:
    given = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?:(\d+)(?:[/?#]|$)", 1)
    return F.when(given != "", given).when(urls.part(url, "scheme") == "https", "443").otherwise("80")


def downgrade(url: Column, origin: Column) -> Column:
    return (urls.part(origin, "scheme") == "https") & (urls.part(url, "scheme") == "http")


def same_origin(url: Column, origin: Column) -> Column:
    return (urls.part(url, "host") == urls.part(origin, "host")) & (_port(url) == _port(origin))


def denial(url: Column, origin: Column, relation: Column, *, addresses: Column | None = None, allow_private: bool = False, allow_cross_origin: bool = False) -> Column:
    """Why a request is denied: unsupported_url_scheme, cross_origin_follow_up or private_network; null if it is allowed."""
    follow = F.lit(False) if allow_cross_origin else relation != "initial"
    private = F.lit(False) if allow_private else private_target(url, addresses)
    return (
        F.when(follow & downgrade(url, origin), "unsupported_url_scheme")
        .when(follow & ~F.coalesce(same_origin(url, origin), F.lit(False)), "cross_origin_follow_up")
        .when(private, "private_network")
    )


def redirect_denial(source: Column, target: Column, origin: Column, relation: Column, **options) -> Column:
    """As denial, and a redirect from https to http is never followed."""
    return F.when(downgrade(target, source), "unsupported_url_scheme").otherwise(denial(target, origin, relation, **options))
