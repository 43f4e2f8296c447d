"""Feeds and embedded data: rows (body) of whole answers to rows of schema.ATS_JOB."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions import dates
from postloom.functions.html import html_to_text_column
from postloom.functions.names import is_placeholder_employer
from postloom.functions.places import join_location, strip_flags
from postloom.functions.text import clean_text, employment_type, trim_space, truncate
from postloom.functions.urls import is_http_url
from postloom.session import ship
from postloom.sources.boards import DESCRIPTION_LENGTH, MAX_AGE, judged, order_of, records, row, text

FEED_AGE = timedelta(days=120)
ITEM = "title string, link string, guid string, pubDate string, description string, content string"


def items(answers: DataFrame, schema: str) -> DataFrame:
    """(ord, i): the items of RSS documents. A body that is no RSS fails the query. Names with a prefix are read without it."""
    plain = F.regexp_replace(F.regexp_replace("body", r"<(/?)content:encoded\b", "<$1content"), r"<guid\b[^>]*>", "<guid>")
    doc = F.from_xml(plain, f"channel struct<item:array<struct<{schema.replace(' string', ':string')}>>>")
    checked = F.when(F.col("body").rlike(r"(?s)<rss\b.*<channel\b"), doc["channel"]["item"]).otherwise(F.raise_error(F.lit("a body is no RSS feed")).cast(f"array<struct<{schema.replace(' string', ':string')}>>"))
    return answers.select(F.monotonically_increasing_id().alias("_a"), F.posexplode(checked).alias("_i", "i")).select(order_of("_a", "_i"), "i")


def rss(answers: DataFrame, now: datetime, max_age: timedelta = FEED_AGE) -> DataFrame:
    """A full listing. Items without a date stay; with an unreadable or old one they go."""
    ship(answers.sparkSession)
    i = items(answers, ITEM)
    published = dates.parse_date(F.col("i.pubDate"), dates.FEED_FORMS)
    i = i.where(~dates.date_problem(F.col("i.pubDate"), published) & F.coalesce(published >= F.lit(now - max_age).cast("timestamp"), F.lit(True)))
    link = clean_text(text(F.col("i.link")))
    link = F.when(is_http_url(link), link).otherwise("")
    guid = clean_text(text(F.col("i.guid")))
    body = F.when(trim_space(text(F.col("i.content"))) != "", F.col("i.content")).otherwise(F.col("i.description"))
    return i.select(*row("feed", external_id=F.when(guid != "", guid).otherwise(link), title=clean_text(text(F.col("i.title"))), url=link, description=html_to_text_column(body), published_at=published))


def weworkremotely(answers: DataFrame, now: datetime) -> DataFrame:
    """Judged rows; a title is "employer: title", and without that the record is invalid."""
    ship(answers.sparkSession)
    i = items(answers, "title string, region string, country string, type string, description string, pubDate string, expires_at string, guid string, link string")
    title = text(F.col("i.title"))
    at = F.instr(title, ": ")
    link = trim_space(text(F.col("i.link")))
    link = F.when(link != "", link).otherwise(trim_space(text(F.col("i.guid"))))
    published, expires = dates.parse_date(F.col("i.pubDate")), dates.parse_date(F.col("i.expires_at"))
    country = strip_flags(text(F.col("i.country")))
    rows = i.select(
        *row(
            "weworkremotely",
            external_id=F.regexp_extract(F.coalesce(F.try_parse_url(link, F.lit("PATH")), F.lit("")), "^/remote-jobs/([^/]+)$", 1),
            title=F.when(at > 0, F.substr(title, at + 2)).otherwise(""),
            url=link,
            employer=F.when(at > 0, F.substr(title, F.lit(1), at - 1)).otherwise(""),
            location_raw=F.when(country != "", country).otherwise(trim_space(text(F.col("i.region")))),
            description=html_to_text_column(F.col("i.description")),
            published_at=published,
            expires_at=expires,
            employment_type=employment_type(F.col("i.type")),
        ),
        (dates.date_problem(F.col("i.pubDate"), published) | dates.date_problem(F.col("i.expires_at"), expires)).alias("bad_date"),
    )
    return judged(rows, "weworkremotely.com", now)


def ethiojobs(answers: DataFrame, now: datetime) -> DataFrame:
    """Postings in the data embedded in listing pages (bodies are that JSON). One past its deadline is a closure marker;
    without a readable date, too old, or of a hidden employer it goes."""
    ship(answers.sparkSession)
    inner = F.to_json(F.from_json("body", "props struct<pageProps:struct<jobs:struct<data:variant>>>")["props"]["pageProps"]["jobs"])
    schema = "title string, slug string, description string, date_published string, date_expiry string, state string, city string, company struct<name:string>"
    r = records(answers.select(inner.alias("body")), "data", schema)
    slug = trim_space(text(F.col("r.slug")))
    fine = slug.rlike("^[a-zA-Z0-9-]{1,300}$")
    job_id = F.when(fine, F.substring_index(slug, "-", 1)).otherwise("")
    job_id = F.when(F.length(job_id).between(6, 16), job_id).otherwise("")
    employer, title = clean_text(text(F.col("r.company.name"))), clean_text(text(F.col("r.title")))
    expires, published = dates.parse_date(F.col("r.date_expiry")), dates.parse_date(F.col("r.date_published"))
    ended = F.coalesce(expires <= F.lit(now).cast("timestamp"), F.lit(False))
    fresh = F.coalesce(published >= F.lit(now - MAX_AGE).cast("timestamp"), F.lit(False))
    rows = r.where((job_id != "") & ~is_placeholder_employer(employer) & (title != "") & (ended | fresh))
    live = lambda c: F.when(~ended, c)
    return rows.select(*row(
        "ethiojobs", external_id=job_id, employer=employer, closed=ended, title=F.coalesce(live(title), F.lit("")), url=F.coalesce(live(F.concat(F.lit("https://ethiojobs.net/job/"), slug)), F.lit("")),
        location_raw=F.coalesce(live(join_location(F.col("r.city"), F.col("r.state"))), F.lit("")), description=F.coalesce(live(truncate(html_to_text_column(F.col("r.description")), DESCRIPTION_LENGTH)), F.lit("")), published_at=live(published), expires_at=live(expires),
    ))
