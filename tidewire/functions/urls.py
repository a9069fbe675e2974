"""URLs, domains, ids and source grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def _parts(url: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.regexp_extract(url, p, 1) for p in (_SCHEME, _AUTHORITY, _PATH, _QUERY))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and authority, drop fragment, tracking parameters and trailing slashes."""
    scheme, authority, path, query = _parts(url)
    body = F.regexp_extract(path, r"^((?:.*/)?[^/;]*)", 1)
    extra = F.substring(path, F.length(body) + 1, F.length(path))
    key = lambda x: F.lower(F.substring_index(x, "=", 1))
    keep = F.filter(
        F.split(query, "&"), lambda x: (x != "") & ~F.startswith(key(x), F.lit(params.TRACKING_PREFIX)) & ~key(x).isin(*params.TRACKING_PARAMS)
    )
    kept = F.array_join(keep, "&")
    bare = F.regexp_replace(body, "/+$", "")
    bare = F.when(bare == "", F.lit("/")).otherwise(bare)
    head = F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(F.lit("")), F.when(authority != "", F.concat(F.lit("//"), F.lower(authority))).otherwise(F.lit("")))
    lead = F.when((authority != "") & ~F.startswith(bare, F.lit("/")), F.lit("/")).otherwise(F.lit(""))
    return F.concat(
        head, lead, bare, F.when(F.length(extra) > 1, extra).otherwise(F.lit("")), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))
    )


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, drop the default port, give an empty path a slash."""
    scheme, authority, path, _ = _parts(url)
    tail = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?(.*)$", 1)
    low = F.lower(scheme)
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    host = F.lower(F.substring(authority, F.length(user) + 1, F.length(authority)))
    host = F.when(low == "http", F.regexp_replace(host, r":80$", "")).when(low == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    return F.when(authority == "", url).otherwise(F.concat(low, F.lit("://"), user, host, F.when(path == "", F.lit("/")).otherwise(F.lit("")), tail))


def source_domain(url: Column) -> Column:
    """The authority, port and user included, without any "www."."""
    return F.replace(F.regexp_extract(url, _AUTHORITY, 1), F.lit("www."), F.lit(""))


def reliability(domain: Column, high=params.HIGH_DOMAINS, high_suffixes=params.HIGH_SUFFIXES, medium=params.MEDIUM_DOMAINS, low=params.LOW_DOMAINS) -> Column:
    """high, medium, low or unknown, by exact domain or official suffix."""
    d = F.replace(F.lower(domain), F.lit("www."), F.lit(""))
    official = F.lit(False)
    for s in high_suffixes:
        official = official | F.endswith(d, F.lit(s))
    return F.when(d.isin(*high) | official, "high").when(d.isin(*medium), "medium").when(d.isin(*low), "low").otherwise("unknown")


def reliability_weight(grade: Column) -> Column:
    return F.when(grade == "high", 3).when(grade == "medium", 2).when(grade == "low", 1).otherwise(0)


def is_official(domain: Column, keywords=params.OFFICIAL_KEYWORDS) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(domain, F.lit(k))
    return out


def _digest(prefix: str, text: Column, n: int) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("binary"), 256), 1, n))


def article_id(url: Column) -> Column:
    return _digest("art_", normalize_url(url), 12)


def result_id(url: Column, title: Column) -> Column:
    return _digest("res_", F.lower(F.concat(url, F.lit("|"), title)), 12)


def event_id(title: Column) -> Column:
    return _digest("evt_", F.lower(F.substring(title, 1, 50)), 10)


def item_id(rank: Column) -> Column:
    return F.concat(F.lit("item_"), F.when(rank < 1000, F.lpad(rank.cast("string"), 3, "0")).otherwise(rank.cast("string")))


def report_id(report_date: Column) -> Column:
    return F.concat(F.lit("daily_"), F.date_format(report_date, "yyyyMMdd"))
