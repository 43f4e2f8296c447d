"""Careers sites: a listing page links to the pages of its postings. Both come as fetched bodies; rows are schema.ATS_JOB."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import dates
from postloom.functions.html import html_to_text_column, main_text_column, page_column
from postloom.functions.text import clean_text, trim_space, truncate
from postloom.functions.urls import is_http_url, same_host, strip_tracking
from postloom.session import ship
from postloom.sources.boards import DESCRIPTION_LENGTH, row, text

MAX_AGE, MOST_LINKS, LONGEST_ANCHOR = timedelta(days=120), 100, 120
# Parts of a path, and kinds of files, that are no postings.
FURNITURE = (
    "feed", "rss", "page", "apply", "category", "tag", "search", "culture", "benefits", "perks", "values", "about", "team", "faq", "faqs", "contact", "departments", "locations",
    "diversity", "life", "why-join-us", "how-we-hire", "hiring-process",
)
FILES = (".pdf", ".doc", ".docx", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".zip", ".xml", ".css", ".js")
# Link texts that name an action; what parts a page's title from its site's name.
ACTIONS = ("read more", "apply", "apply now", "view", "view details", "details", "learn more", "more", "see more", "view job", "view more")
SEPARATORS = (" | ", " - ", " – ", " — ")


def anchor_title(c: Column) -> Column:
    """What a link's text says before an arrow, if it can be a title; ''."""
    cut = trim_space(F.substring_index(F.coalesce(c, F.lit("")), "→", 1))
    return F.when(F.lower(cut).isin(*ACTIONS) | (F.length(cut) > LONGEST_ANCHOR), "").otherwise(cut)


def clean_page_title(c: Column) -> Column:
    """A page's title without the site's name after the last of each separator."""
    out = F.coalesce(c, F.lit(""))
    for s in SEPARATORS:
        out = F.regexp_replace(out, rf"(?s)^(.+){'[|]'.join(s.split('|'))}.*$", "$1")
    return clean_text(out)


def looks_like_id(c: Column) -> Column:
    """Nothing, or eight and more hex digits and dashes."""
    return (F.coalesce(c, F.lit("")) == "") | c.rlike(r"^[0-9a-fA-F-]{8,}$")


def title_from_slug(url: Column) -> Column:
    """The last part of a URL's path as a title: legal-counsel is Legal Counsel; '' for identifiers."""
    slug = F.regexp_extract(F.rtrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), r"([^/]*)$", 1)
    words = F.filter(F.split(slug, "[-_]"), lambda w: w != "")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")
    return F.when(looks_like_id(slug), "").otherwise(titled)


def first_said(*columns: Column) -> Column:
    """The first that is not blank; ''."""
    return F.coalesce(*(F.when(trim_space(c) != "", c) for c in columns), F.lit(""))


def candidates(listings: DataFrame) -> DataFrame:
    """(listing, place, key, url, text): links of each listing (url, html) below its own path on its site, once by host, path
    and query without tracking, in the page's order. The first text that a link is given counts."""
    ship(listings.sparkSession)
    path = lambda c: F.rtrim(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), F.lit("/"))
    links = listings.select(F.col("url").alias("listing"), page_column(F.col("url"), F.col("html"))["links"].alias("links"))
    links = links.select("listing", F.posexplode("links").alias("place", "l")).select("listing", "place", F.col("l.url").alias("link"), F.col("l.text").alias("text"))
    links = links.withColumn("_path", path(F.col("link"))).withColumn("_below", F.concat(path(F.col("listing")), F.lit("/")))
    rest = F.split(F.lower(F.expr("substring(_path, length(_below) + 1)")), "/")
    wanted = same_host(F.col("listing"), F.col("link")) & F.col("_path").startswith(F.col("_below")) & ~F.arrays_overlap(rest, F.array(*map(F.lit, FURNITURE)))
    wanted = wanted & ~F.regexp_extract(F.lower("_path"), r"([.][^./]*)$", 1).isin(*FILES)
    links = links.where(F.coalesce(wanted, F.lit(False)))
    query = strip_tracking(F.try_parse_url("link", F.lit("QUERY")))
    tail = F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    site = F.regexp_replace(F.lower(F.regexp_extract("link", r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]*)", 1)), r"^www[.]", "")
    links = links.withColumn("key", F.concat(site, "_path", tail)).withColumn("url", F.concat(F.regexp_extract("link", r"^([^?#]*)", 1), tail))
    said = F.when(F.col("text") != "", F.col("place"))
    return links.groupBy("listing", "key").agg(F.min("place").alias("place"), F.min_by("url", "place").alias("url"), F.coalesce(F.min_by("text", said), F.lit("")).alias("text"))


@dataclass
class Listed:
    """rows: the postings; problems: listings (listing, problem) that say nothing, so that nothing may be closed by them."""

    rows: DataFrame
    problems: DataFrame


def careers_site(listings: DataFrame, details: DataFrame, now: datetime, max_age: timedelta = MAX_AGE, most: int = MOST_LINKS) -> Listed:
    """Postings of careers sites, each a full listing.

    listings: (url, html), null html for one that was not found. details: (url, status, html) of the linked pages. A posting
    whose page is gone (404, 410), too old or past its end goes; one whose page could not be had stays, with what its link says.
    A listing is a problem if its URL is no page below a site's root, if it was not found, if it has no links, or if it has
    more than `most`, as cutting it would close what lies behind the cut.
    """
    ship(listings.sparkSession)
    rooted = ~is_http_url(F.col("url")) | (F.btrim(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/")) == "")
    known = listings.select("url", "html", F.when(rooted, "invalid").when(F.col("html").isNull(), "not found").alias("problem"))
    links = candidates(known.where("problem is null"))
    counts = links.groupBy(F.col("listing").alias("url")).agg(F.count(F.lit(1)).alias("n"))
    judged = known.join(counts, "url", "left").select(F.col("url").alias("listing"), F.coalesce("problem", F.when(F.col("n").isNull(), "no links").when(F.col("n") > most, "too many links")).alias("problem"))
    good = links.join(judged.where("problem is null").select("listing"), "listing", "left_semi")

    page = details.select(F.col("url").alias("_url"), "status", "html", page_column(F.col("url"), F.col("html")).alias("p"))
    fetched = F.col("html").isNotNull() & F.col("status").between(200, 299)
    j = good.join(page, F.col("url") == F.col("_url"), "left").withColumn("_p", F.when(fetched, F.col("p"))).withColumn("_j", F.get("_p.postings", 0))
    at = F.lit(now).cast("timestamp")
    # within lambdas the forms are one small expression however often the dates are used
    first_date = lambda *cs: F.get(F.filter(F.transform(F.array(*cs), lambda c: dates.parse_date(c, dates.BOARD_FORMS)), lambda t: t.isNotNull()), 0)
    posted = first_date(F.col("_j.date_posted"), F.col("_p.meta")["article:published_time"], F.col("_p.meta")["dateposted"])
    ends = first_date(F.col("_j.valid_through"))
    gone = F.coalesce(F.col("status").isin(404, 410), F.lit(False))
    over = F.coalesce(posted < F.lit(now - max_age).cast("timestamp"), F.lit(False)) | F.coalesce(ends < at, F.lit(False))
    j = j.where(~gone & ~over)
    anchor = anchor_title(F.col("text"))
    title = first_said(F.col("_j.title"), F.col("_p.h1"), anchor, clean_page_title(F.col("_p.title")), title_from_slug(F.col("url")))
    body = F.when(F.col("_p").isNull(), "").when(text(F.col("_j.description")) != "", html_to_text_column(F.col("_j.description"))).otherwise(main_text_column(F.col("html")))
    order = F.struct(F.xxhash64("listing").alias("answer"), F.col("place").cast("int").alias("place"))
    j = j.withColumn("ord", order)
    rows = j.select("listing", *row("careers", external_id=F.col("key"), title=title, url=F.col("url"), location_raw=text(F.col("_j.location")), description=truncate(F.coalesce(body, F.lit("")), DESCRIPTION_LENGTH), published_at=posted, expires_at=ends))
    return Listed(rows, judged.where("problem is not null"))
