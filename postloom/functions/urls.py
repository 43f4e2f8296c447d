"""URLs: whether one belongs to a site, and links without their analytics parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track; so does everything that begins with utm_.
TRACKING = ("ref", "fbclid", "gclid", "source")


def host(c: Column) -> Column:
    """The host in lower case, without its port; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r":\d+$", "")


def own_url(c: Column, *domains: str) -> Column:
    """An https URL on one of the domains or below it."""
    h = host(c)
    on = F.lit(False)
    for d in domains:
        on = on | (h == d) | h.endswith(f".{d}")
    return F.coalesce((F.try_parse_url(c, F.lit("PROTOCOL")) == "https") & on, F.lit(False))


def same_host(a: Column, b: Column) -> Column:
    """The same host, but for a leading www. and the port."""
    bare = lambda c: F.regexp_replace(host(c), r"^www\.", "")
    return F.coalesce(bare(a) == bare(b), F.lit(False))


def is_http_url(c: Column) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")).isin("http", "https") & (F.coalesce(host(c), F.lit("")) != ""), F.lit(False))


def strip_tracking(query: Column) -> Column:
    """A raw query string without tracking parameters, by key; values of one key keep their order."""
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")
    keyed = F.transform(parts, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    kept = F.filter(keyed, lambda p: ~(F.lower(p["k"]).isin(*TRACKING) | F.lower(p["k"]).startswith("utm_")))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: p["p"]), "&")
