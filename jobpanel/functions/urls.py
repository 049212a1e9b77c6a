"""Rules on archived URLs and page text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import alternation, count_hits, has_any, lookup, squeeze, strip

# scheme, authority, path and query of a URI reference (RFC 3986, appendix B)
_URI = r"^(?:[^:/?#]+:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URI, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _URI, 2)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, _URI, 3)


def normal_path(path: Column) -> Column:
    p = F.lower(F.trim(path))
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    p = F.regexp_replace(p, "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def is_root_path(url: Column) -> Column:
    return normal_path(url_path(url)).isin(*fixed.ROOT_PATHS)


def is_job_url(url: Column) -> Column:
    hay = F.concat(
        url_host(url), normal_path(url_path(url)), F.lit("?"), F.lower(F.trim(url_query(url))))
    return has_any(hay, fixed.JOB_URL_KEYWORDS)


def is_high_value(url: Column) -> Column:
    return (
        (url != "") & ~url.contains("@") & (url_host(url) != "") & ~is_root_path(url) & is_job_url(url)
    )


def has_job_intent(timestamp: Column, url: Column, year: str) -> Column:
    """Capture of `year` whose URL points at a posting; exclusions come first."""
    u = F.trim(url)
    return (
        timestamp.startswith(year)
        & (u != "")
        & ~has_any(F.lower(u), fixed.URL_EXCLUDE)
        & (has_any(F.lower(url_path(u)), fixed.URL_INCLUDE_PATHS)
           | has_any(F.lower(url_query(u)), fixed.URL_INCLUDE_QUERY))
    )


def low_value_reason(text: Column, min_chars: int = fixed.MIN_PAGE_TEXT) -> Column:
    t = F.coalesce(text, F.lit(""))
    compact = squeeze(t)
    boilerplate = (count_hits(compact, fixed.BOILERPLATE_MARKERS) >= 2) & (
        F.length(compact) < max(2 * min_chars, 800))
    return (
        F.when(F.length(t) < min_chars, "too_short").when(boilerplate, "boilerplate").otherwise("")
    )


def platform_of_host(host: Column) -> Column:
    h = F.lower(F.coalesce(host, F.lit("")))
    out = F.lit("other")
    for hints, name in reversed(fixed.PLATFORM_HOSTS):
        out = F.when(has_any(h, hints), name).otherwise(out)
    return out


def platform_name(platform: Column, domain: Column) -> Column:
    key = strip(F.coalesce(platform, F.lit("")))
    return (
        F.coalesce(lookup(fixed.PLATFORM_NAMES, key), F.nullif(key, F.lit("")),
                   strip(domain), F.lit(""))
    )


def is_clean_seed(url: Column, domain: Column, platform: Column, platforms) -> Column:
    hints = [h for hosts, name in fixed.PLATFORM_HOSTS if name in platforms for h in hosts]
    known = platform.isin(*platforms)
    if hints:
        known = known | domain.rlike(alternation(hints))
    return (
        known
        & ~url.contains("@")
        & ~domain.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$")
        & (F.length(url) <= fixed.SEED_URL_MAX)
    )


def capture_date(timestamp: Column) -> Column:
    """YYYY-MM-DD of a 14-digit capture time, '' when it is no date."""
    head = F.regexp_extract(F.trim(timestamp), r"^(\d{8})", 1)
    date = F.try_to_timestamp(head, F.lit("yyyyMMdd"))
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))
