"""URL parts, canonical form, scope and policy predicates as Column expressions.

URLs are taken as text, ASCII host assumed; what needs a URL parser's
normalisation (percent-encoded hosts, dot segments) is left as it stands.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Parameters that only track, and suffixes under which anyone can register.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "dclid", "fbclid", "msclkid")
SUFFIXES = ("com", "org", "net", "edu", "gov", "info", "io", "dev", "app", "de", "fr", "es", "uk", "co.uk", "org.uk", "ac.uk", "jp", "co.jp", "au", "com.au", "br", "com.br", "cn", "com.cn", "in", "github.io", "blogspot.com")

_URL = r"(?i)^(https?)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@]*)(?::(\d*))?(/[^?#]*)?(\?[^#]*)?(#.*)?\z"


def part(url: Column, name: str) -> Column:
    index = {"scheme": 1, "userinfo": 2, "host": 3, "port": 4, "path": 5, "query": 6, "fragment": 7}[name]
    found = F.regexp_extract(url, _URL, index)
    if name == "host":
        return F.regexp_replace(F.lower(found), r"\.\z", "")
    if name == "path":
        return F.when(found == "", "/").otherwise(found)
    return F.lower(found) if name == "scheme" else found


def is_anonymous_http(url: Column) -> Column:
    return url.rlike(_URL) & (part(url, "userinfo") == "") & (part(url, "host") != "")


def authority(url: Column) -> Column:
    """Host, with the port unless it is the scheme's own."""
    port = part(url, "port")
    default = F.when(part(url, "scheme") == "https", "443").otherwise("80")
    return F.concat(part(url, "host"), F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)))


def origin(url: Column) -> Column:
    return F.concat(part(url, "scheme"), F.lit("://"), authority(url))


def canonical(url: Column) -> Column:
    """Without fragment and tracking parameters, the others in order; null unless anonymous HTTP(S)."""
    pairs = F.split(F.substring(part(url, "query"), 2, 1 << 30), "&")
    kept = F.filter(pairs, lambda p: ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING))
    query = F.when(part(url, "query") == "", "").when(F.size(kept) == 0, "").otherwise(F.concat(F.lit("?"), F.array_join(kept, "&")))
    query = F.when(query == "?", "").otherwise(query)
    return F.when(is_anonymous_http(url), F.concat(origin(url), part(url, "path"), query))


def host_in(host: Column, domain: Column, subdomains: bool = True) -> Column:
    return (host == domain) | (host.endswith(F.concat(F.lit("."), domain)) if subdomains else F.lit(False))


def in_scope(url: Column, sites: list[str], excluded: list[str], subdomains: bool = True) -> Column:
    """Any of the sites, or no sites given, and none of the excluded."""
    host = part(url, "host")
    any_of = lambda domains: F.exists(F.array(*map(F.lit, domains)), lambda d: host_in(host, d, subdomains)) if domains else F.lit(False)
    return is_anonymous_http(url) & (any_of(sites) if sites else F.lit(True)) & ~any_of(excluded)


def may_fetch(url: Column) -> Column:
    """Anonymous HTTP(S) on its default port, no escapes in the host."""
    port = part(url, "port")
    default = F.when(part(url, "scheme") == "https", "443").otherwise("80")
    return is_anonymous_http(url) & ((port == "") | (port == default)) & ~part(url, "host").contains("%")


def may_redirect(source: Column, target: Column, hop: Column, most: int) -> Column:
    """Null if a redirect may be followed, else why not."""
    return (
        F.when(hop >= most, "FETCH_BLOCKED:limit").when(target.isNull() | (target == ""), "HTTP_ERROR:location").when(~may_fetch(target), "FETCH_BLOCKED:policy")
        .when((part(source, "scheme") == "https") & (part(target, "scheme") != "https"), "FETCH_BLOCKED:downgrade")
    )


def display_url(url: Column) -> Column:
    """The URL if it may be shown as a link, else null."""
    host = part(url, "host")
    bare = F.regexp_replace(host, r"^\[|\]\z", "")
    local = (bare == "localhost") | bare.endswith(".localhost") | bare.endswith(".local")
    dotted = bare.contains(".") | bare.contains(":")
    v4 = bare.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}\z")
    public = ~(v4 | bare.contains(":")) | is_public_address(bare)
    return F.when((F.length(url) <= 4096) & is_anonymous_http(url) & dotted & ~local & public, url)


def normal_domain(name: Column) -> Column:
    """A registrable DNS name in lower case without root dot; null for addresses, URLs, suffixes and malformed names."""
    host = F.regexp_replace(F.lower(name), r"\.\z", "")
    labels = F.split(host, r"\.")
    good = F.forall(labels, lambda x: x.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\z"))
    last_numeric = F.element_at(labels, -1).rlike(r"^(?:\d+|0x[0-9a-f]*)\z")
    return F.when(~name.rlike(r"[\s/:@*?#\\]") & (F.length(host) <= 253) & (F.size(labels) >= 2) & good & ~last_numeric & registrable(host).isNotNull(), host)


def registrable(host: Column) -> Column:
    """The label before the longest known suffix, with it; null for a suffix itself.  An unknown last label is a suffix."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - (k - 1), F.lit(1)), k), ".")
    two = tail(2).isin(*[s for s in SUFFIXES if "." in s]) & (n >= 2)
    return F.when(two, F.when(n >= 3, tail(3))).otherwise(F.when(n >= 2, tail(2)))


def metadata(url: Column, final_url: Column | None = None) -> Column:
    """What a URL alone says about its source."""
    at = url if final_url is None else F.coalesce(final_url, url)
    host = part(at, "host")
    icon = display_url(F.concat(origin(at), F.lit("/favicon.ico")))
    return F.struct(
        url.alias("source_url"), (F.lit(None).cast("string") if final_url is None else final_url).alias("final_url"), host.alias("hostname"),
        F.coalesce(registrable(host), host).alias("domain"), origin(at).alias("origin"), F.concat(authority(at), part(at, "path"), part(at, "query")).alias("display_url"),
        host.alias("site_name"), icon.alias("favicon_url"), F.lit("url_only").alias("metadata_source"), F.when(icon.isNotNull(), "origin_fallback").otherwise("none").alias("favicon_provenance"),
    )


def _range(address: str | None) -> str | None:
    try:
        ip = ipaddress.ip_address(address or "")
    except ValueError:
        return None
    for name in ("unspecified", "loopback", "link_local", "multicast", "private", "reserved"):
        if getattr(ip, f"is_{name}"):
            return name
    return "unicast" if ip.is_global else "special"


@F.pandas_udf(StringType())
def address_range(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The kind of range an IPv4 or IPv6 address lies in; null if it is none."""
    for part_ in parts:
        yield part_.map(_range)


def is_public_address(address: Column) -> Column:
    return F.coalesce(address_range(address) == "unicast", F.lit(False))


@F.pandas_udf(StringType())
def idna_ascii(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The ASCII form of a host name; null if it has none."""

    def one(name: str | None) -> str | None:
        try:
            return None if name is None else name.encode("idna").decode().lower()
        except UnicodeError:
            return None

    for part_ in parts:
        yield part_.map(one)
