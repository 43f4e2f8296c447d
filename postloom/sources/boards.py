"""Job boards whose answers are JSON: rows (body) of whole answers to rows of schema.ATS_JOB.

An answer without its list of postings is an error, never an empty board. Postings are decoded one by one, so that one odd
record costs only itself.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import dates
from postloom.functions.html import html_to_text_column
from postloom.functions.names import is_placeholder_employer
from postloom.functions.places import clean_location
from postloom.functions.text import clean_text, collapse_space, employment_type, trim_space, truncate, workplace_from_location, workplace_type
from postloom.functions.urls import own_url
from postloom.session import ship

DESCRIPTION_LENGTH, LOCATION_LENGTH = 20_000, 300
MAX_AGE = timedelta(days=20)


def read_bodies(spark, path: str) -> DataFrame:
    """One row (body) for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("body"))


def order_of(answer: str, place: str) -> Column:
    """A posting's place among all: pairs, as a number made of both would overflow with many answers or long ones."""
    return F.struct(F.col(answer).cast("bigint").alias("answer"), F.col(place).cast("int").alias("place")).alias("ord")


def records(answers: DataFrame, listed: str | None, schema: str) -> DataFrame:
    """(ord, raw, r): the postings of all answers; r is null for a record that does not fit the schema. listed: the field that
    holds them, or None if the answer is the list. An answer without them fails the query."""
    kind = "array<variant>"
    whole = F.from_json("body", kind if listed is None else f"{listed} {kind}")
    found = whole if listed is None else whole[listed]
    listed_or_fail = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit("an answer has no list of postings")).cast(kind))
    rows = answers.select(F.monotonically_increasing_id().alias("_a"), F.posexplode(listed_or_fail).alias("_i", "raw"))
    rows = rows.select(order_of("_a", "_i"), F.to_json("raw").alias("raw"))
    return rows.withColumn("r", F.when(F.col("raw").startswith("{"), F.from_json("raw", schema, {"mode": "PERMISSIVE"})))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def row(source: str, **columns: Column) -> list[Column]:
    """Columns of ATS_JOB; what is not given is unknown."""
    blank = {c: F.lit("") for c in ("external_id", "title", "url", "location_raw", "description", "remote_type", "employment_type", "employer")}
    base = {"source": F.lit(source), "ord": F.col("ord"), **blank, "published_at": F.lit(None).cast("timestamp"), "expires_at": F.lit(None).cast("timestamp"), "closed": F.lit(False)} | columns
    order = ("source", "ord", "external_id", "title", "url", "location_raw", "description", "published_at", "expires_at", "remote_type", "employment_type", "employer", "closed")
    return [base[c].alias(c) for c in order]


def greenhouse(answers: DataFrame) -> DataFrame:
    """A full listing; a posting without an id keeps an empty one, so that it is seen and skipped."""
    ship(answers.sparkSession)
    r = records(answers, "jobs", "id bigint, title string, absolute_url string, location struct<name:string>, content string, first_published string").where("r is not null")
    place = text(F.col("r.location.name"))
    return r.select(*row(
        "greenhouse", external_id=F.when(F.coalesce("r.id", F.lit(0)) != 0, F.col("r.id").cast("string")).otherwise(""), title=clean_text(text(F.col("r.title"))), url=clean_text(text(F.col("r.absolute_url"))),
        location_raw=clean_text(place), description=html_to_text_column(F.col("r.content")), published_at=dates.parse_date(F.col("r.first_published")), remote_type=workplace_from_location(place),
    ))


def lever(answers: DataFrame) -> DataFrame:
    ship(answers.sparkSession)
    schema = "id string, text string, hostedUrl string, createdAt bigint, workplaceType string, categories struct<commitment:string,location:string,allLocations:array<string>>, descriptionPlain string, lists array<struct<text:string,content:string>>, additionalPlain string"
    r = records(answers, None, schema).where("r is not null")
    link = trim_space(text(F.col("r.hostedUrl")))
    places = F.when(F.size("r.categories.allLocations") > 1, F.array_join("r.categories.allLocations", "; ")).otherwise(text(F.col("r.categories.location")))
    # the lists' contents go through the HTML reader as one text, each under its heading
    listed = F.array_join(F.transform(F.coalesce("r.lists", F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat(F.lit("<p>"), text(x["text"]), F.lit("<br>"), text(x["content"]), F.lit("</p>"))), "")
    parts = F.filter(F.array(clean_text(text(F.col("r.descriptionPlain"))), html_to_text_column(listed), clean_text(text(F.col("r.additionalPlain")))), lambda p: p != "")
    return r.select(*row(
        "lever", external_id=trim_space(text(F.col("r.id"))), title=clean_text(text(F.col("r.text"))), url=F.when(own_url(link, "lever.co"), link).otherwise(""), location_raw=truncate(clean_text(places), LOCATION_LENGTH),
        description=truncate(F.array_join(parts, "\n\n"), DESCRIPTION_LENGTH), published_at=F.when(F.col("r.createdAt") > 0, F.timestamp_millis("r.createdAt")), remote_type=workplace_type(F.col("r.workplaceType")),
        employment_type=employment_type(F.col("r.categories.commitment")),
    ))


def ashby(answers: DataFrame) -> DataFrame:
    """A full listing; postings that are not listed publicly are left out."""
    ship(answers.sparkSession)
    schema = "id string, title string, location string, secondaryLocations array<struct<location:string>>, publishedAt string, isListed boolean, isRemote boolean, workplaceType string, employmentType string, jobUrl string, descriptionPlain string, descriptionHtml string"
    r = records(answers, "jobs", schema).where("r is not null and coalesce(r.isListed, true)")
    link, typed, plain = trim_space(text(F.col("r.jobUrl"))), workplace_type(F.col("r.workplaceType")), trim_space(text(F.col("r.descriptionPlain")))
    places = F.filter(F.transform(F.concat(F.array("r.location"), F.coalesce(F.col("r.secondaryLocations.location"), F.array().cast("array<string>"))), lambda x: trim_space(text(x))), lambda x: x != "")
    return r.select(*row(
        "ashby", external_id=trim_space(text(F.col("r.id"))), title=clean_text(text(F.col("r.title"))), url=F.when(own_url(link, "ashbyhq.com"), link).otherwise(""),
        location_raw=truncate(clean_text(F.array_join(places, "; ")), LOCATION_LENGTH), description=truncate(clean_text(F.when(plain != "", plain).otherwise(html_to_text_column(F.col("r.descriptionHtml")))), DESCRIPTION_LENGTH),
        published_at=dates.parse_date(F.col("r.publishedAt"), dates.ISO[:1]), remote_type=F.when((typed == "") & F.coalesce("r.isRemote", F.lit(False)), "remote").otherwise(typed), employment_type=employment_type(F.col("r.employmentType")),
    ))


def first_string(raw: Column) -> Column:
    """The first string of a JSON list, or the string itself."""
    listed = F.get(F.from_json(raw, "array<string>"), 0)
    return F.coalesce(F.when(raw.startswith("["), listed).otherwise(F.btrim(raw, F.lit('"'))), F.lit(""))


def judged(rows: DataFrame, domain: str, now: datetime, bad_date: str = "bad_date") -> DataFrame:
    """Rows of a remote board, finished: verdict is invalid (no id, title, employer, own URL or readable date), dropped
    (hidden employer, too old, expired) or kept; the first row of an id counts."""
    at = F.lit(now).cast("timestamp")
    done = rows.withColumn("title", clean_text(F.col("title"))).withColumn("employer", clean_text(F.col("employer"))).withColumn("url", trim_space(F.col("url")))
    done = done.withColumn("location_raw", truncate(clean_location(F.col("location_raw")), LOCATION_LENGTH)).withColumn("description", truncate(F.col("description"), DESCRIPTION_LENGTH)).withColumn("remote_type", F.lit("remote"))
    invalid = (F.col("external_id") == "") | (F.col("title") == "") | (trim_space(F.col("employer")) == "") | ~own_url(F.col("url"), domain) | F.col(bad_date)
    dropped = is_placeholder_employer(F.col("employer")) | F.coalesce(F.col("published_at") < F.lit(now - MAX_AGE).cast("timestamp"), F.lit(False)) | F.coalesce(F.col("expires_at") <= at, F.lit(False))
    return done.withColumn("verdict", F.when(invalid, "invalid").when(dropped, "dropped").otherwise("kept")).drop(bad_date)


def kept(rows: DataFrame) -> DataFrame:
    """The kept rows of a judged board, the first of each id. A board with records of which none is usable has changed its
    format, which is an error, as is a board without records."""
    total, invalid = rows.agg(F.count(F.lit(1)), F.count_if(F.col("verdict") == "invalid")).first()
    if total == invalid:
        raise ValueError("none of the records is usable" if total else "there are no records")
    by = Window.partitionBy("external_id").orderBy("ord")
    return rows.where("verdict = 'kept'").withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place", "verdict")


def _board(source: str, domain: str, r: DataFrame, now: datetime, written: Column | None = None, published: Column | None = None, **columns: Column) -> DataFrame:
    """Judge a board's records; those that could not be decoded are invalid."""
    parsed = published if published is not None else dates.parse_date(written)
    bad = F.lit(False) if written is None else dates.date_problem(written, parsed)
    rows = r.select(*row(source, published_at=parsed, **columns), F.coalesce(bad | F.col("r").isNull(), F.lit(True)).alias("bad_date"))
    return judged(rows, domain, now)


def remotive(answers: DataFrame, now: datetime) -> DataFrame:
    ship(answers.sparkSession)
    r = records(answers, "jobs", "id string, url string, title string, company_name string, job_type string, publication_date string, candidate_required_location string, description string")
    return _board("remotive", "remotive.com", r, now, F.col("r.publication_date"), external_id=text(F.col("r.id")), title=text(F.col("r.title")), url=text(F.col("r.url")), employer=text(F.col("r.company_name")), location_raw=text(F.col("r.candidate_required_location")), description=html_to_text_column(F.col("r.description")), employment_type=employment_type(F.col("r.job_type")))


def jobicy(answers: DataFrame, now: datetime) -> DataFrame:
    ship(answers.sparkSession)
    r = records(answers, "jobs", "id string, url string, jobTitle string, companyName string, jobType string, jobGeo string, jobDescription string, pubDate string")
    return _board("jobicy", "jobicy.com", r, now, F.col("r.pubDate"), external_id=text(F.col("r.id")), title=text(F.col("r.jobTitle")), url=text(F.col("r.url")), employer=text(F.col("r.companyName")), location_raw=text(F.col("r.jobGeo")), description=html_to_text_column(F.col("r.jobDescription")), employment_type=employment_type(first_string(text(F.col("r.jobType")))))


def remoteok(answers: DataFrame, now: datetime) -> DataFrame:
    """The element with the terms of use is no record."""
    ship(answers.sparkSession)
    r = records(answers, None, "id string, epoch bigint, date string, company string, position string, description string, location string, url string, legal string").where("coalesce(r.legal, '') = ''")
    by_epoch = dates.from_epoch(F.col("r.epoch"))
    return _board("remoteok", "remoteok.com", r, now, F.when(by_epoch.isNull(), F.col("r.date")), F.coalesce(by_epoch, dates.parse_date(F.col("r.date"))), external_id=text(F.col("r.id")), title=text(F.col("r.position")), url=text(F.col("r.url")), employer=text(F.col("r.company")), location_raw=text(F.col("r.location")), description=html_to_text_column(F.col("r.description")))


def workingnomads(answers: DataFrame, now: datetime) -> DataFrame:
    """Identifiers are the number in a posting's own path."""
    ship(answers.sparkSession)
    r = records(answers, None, "url string, title string, description string, company_name string, location string, pub_date string")
    link = text(F.col("r.url"))
    return _board("workingnomads", "workingnomads.com", r, now, F.col("r.pub_date"), external_id=F.regexp_extract(link, r"/job/go/(\d+)", 1), title=text(F.col("r.title")), url=link, employer=text(F.col("r.company_name")), location_raw=text(F.col("r.location")), description=html_to_text_column(F.col("r.description")))


def himalayas(answers: DataFrame, now: datetime) -> DataFrame:
    """Location restrictions are one text or a list; no restriction is no location."""
    ship(answers.sparkSession)
    r = records(answers, "jobs", "title string, companyName string, employmentType string, locationRestrictions string, pubDate bigint, expiryDate bigint, applicationLink string, guid string, description string, excerpt string")
    places = text(F.col("r.locationRestrictions"))
    joined = F.when(places.startswith("["), F.array_join(F.from_json(places, "array<string>"), ", ")).otherwise(places)
    body = F.when(F.coalesce("r.description", F.lit("")) != "", F.col("r.description")).otherwise(F.col("r.excerpt"))
    return _board("himalayas", "himalayas.app", r, now, published=dates.from_epoch(F.col("r.pubDate")), expires_at=dates.from_epoch(F.col("r.expiryDate")), external_id=text(F.col("r.guid")), title=text(F.col("r.title")), url=text(F.col("r.applicationLink")), employer=collapse_space(text(F.col("r.companyName"))), location_raw=joined, description=html_to_text_column(body), employment_type=employment_type(F.col("r.employmentType")))
