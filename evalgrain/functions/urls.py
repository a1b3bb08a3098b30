"""Parts and keys of URLs, by patterns on strings: no row fails on a malformed URL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), _PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def host(url: Column) -> Column:
    """Lower-cased, without user and port; brackets of an IPv6 literal are dropped."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r"^\[([^\]]*)\].*$|:[^:]*$", "$1"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(netloc(url), r":(\d*)$", 1), F.lit(""))


def path(url: Column) -> Column:
    return _part(url, 3)


def query_string(url: Column) -> Column:
    """With its '?', or '' (an empty query counts as none)."""
    q = _part(url, 4)
    return F.when(F.length(q) > 1, q).otherwise("")


def unquoted(text: Column) -> Column:
    """Percent-decoded; text that can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)


def merge_key(url: Column) -> Column:
    """For fusing hit lists: scheme and host in lower case, no 'www.', no slash at the end, query kept, fragment dropped."""
    return F.concat(scheme(url), F.lit("://"), F.regexp_replace(F.lower(netloc(url)), r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""), query_string(url))


def evidence_key(url: Column) -> Column:
    """For matching citations with pages: https, bare host and port, decoded path ('/' if empty), query; '' if not http(s)."""
    ok = scheme(url).isin("http", "https") & (netloc(url) != "")
    place = F.regexp_replace(unquoted(path(url)), "/+$", "")
    at = F.when(F.coalesce(port(url).cast("int"), F.lit(0)) > 0, F.concat(F.lit(":"), port(url))).otherwise("")
    return F.when(ok, F.concat(F.lit("https://"), bare_host(url), at, F.when(place == "", "/").otherwise(place), query_string(url))).otherwise("")


def candidate_key(url: Column) -> Column:
    """For choosing pages to open: lower case, fragment dropped."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", ""))


def redirect_target(url: Column) -> Column:
    """What lies between '/RU=' and '/RK=' in a redirecting URL, decoded; other URLs as they are."""
    found = F.regexp_extract(url, r"/RU=(.*?)/RK=", 1)
    return F.when(found != "", unquoted(found)).otherwise(url)


def rejection(url: Column) -> Column:
    """Why a page fetcher must not open a URL, or null; literal addresses are judged apart (operators.pages)."""
    parts = F.struct(
        scheme(url).alias("scheme"), F.regexp_replace(host(url), r"\.+$", "").alias("host"),
        netloc(url).contains("@").alias("user"), F.coalesce(port(url), F.lit("")).alias("port"),
    )
    return let(
        parts,
        lambda p: F.when(~p["scheme"].isin("http", "https"), "scheme")
        .when(p["host"] == "", "host")
        .when(p["user"], "credentials")
        .when(p["host"].isin("localhost", "localhost.localdomain") | p["host"].endswith(".local"), "local host")
        .when(~p["port"].isin("", "80", "443"), "port"),
    )
