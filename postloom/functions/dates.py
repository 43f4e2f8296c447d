"""Dates as sources write them. Unreadable and missing dates are null; a zone that is not written is UTC."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import trim_space

# The forms of each kind of source, most common first, without the weekday, which carries nothing.
ISO = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd")
MAIL = ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss zzz", "d MMM yy HH:mm xx", "d MMM yy HH:mm zzz")
BOARD_FORMS = (*ISO, *MAIL[:3])
FEED_FORMS = (*MAIL, ISO[0], "d MMM yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")
RESULT_FORMS = ("MMM d, yyyy", "d MMM yyyy", "MMMM d, yyyy")
# Two postings whose identifiers and dates are known, between which identifiers grow evenly.
OLD_ID, NEW_ID, DAYS_BETWEEN, OLD_TIME = 4437765344, 4471199696, 78.6467, datetime(2026, 7, 7, 8, 16, 27, tzinfo=timezone.utc)

WEEKDAY = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),[ ]+"


#: What a run of a form's letters can stand for, loosely.
RUNS = {"y": r"[+-]?\d{2,10}", "M": r"\d{1,2}", "d": r"\d{1,2}", "H": r"\d{1,2}", "m": r"\d{1,2}", "s": r"\d{1,2}", "S": r"\d+", "X": r"(?:Z|[+-][\d:]+)", "x": r"[+-][\d:]+", "z": ".+"}


def shape(form: str) -> str:
    """A pattern that every text of the form matches. A text is looked at with it before it is parsed, as a failed parse costs
    far more than a failed match."""
    out = ""
    for m in re.finditer(r"'(?P<quoted>[^']*)'|(?P<run>([A-Za-z])\3*)|(?P<other>.)", form):
        if m["run"]:
            out += r"\p{L}+[.]?" if m["run"] in ("MMM", "MMMM") else RUNS[m["run"][0]]
        else:
            out += {"[": "(?:", "]": ")?"}.get(m["other"] or "") or re.escape(m["quoted"] or m["other"] or "")
    return f"^{out}$"


def parse_date(c: Column, forms: tuple[str, ...] = BOARD_FORMS) -> Column:
    text = F.regexp_replace(trim_space(c), WEEKDAY, "")
    return F.coalesce(*(F.when(text.rlike(shape(f)), F.try_to_timestamp(text, F.lit(f))) for f in forms))


def date_problem(c: Column, parsed: Column) -> Column:
    """Present but unreadable."""
    return (F.coalesce(trim_space(c), F.lit("")) != "") & parsed.isNull()


def from_epoch(seconds: Column) -> Column:
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def relative_date(c: Column, now: Column) -> Column:
    """"3 days ago" before now, or a written date. A month has 30 days, a year 365; ages over a century are no dates."""
    text = trim_space(c)
    pattern = r"(?i)^(\d+)[\t\n\f\r ]+(minute|hour|day|week|month|year)s?[\t\n\f\r ]+ago$"
    number = F.try_to_number(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit("9" * 18)).cast("bigint")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    seconds = F.when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400).when(unit == "week", 7 * 86400).when(unit == "month", 30 * 86400).when(unit == "year", 365 * 86400)
    ago = F.when(number <= F.floor(F.lit(100 * 365 * 86400) / seconds), F.timestamp_micros(F.unix_micros(now) - number * seconds.cast("bigint") * 1_000_000))
    return F.when(unit != "", ago).otherwise(parse_date(c, RESULT_FORMS))


def posted_from_id(c: Column) -> Column:
    """When a posting with this identifier was published, by a line through the two known ones."""
    days = (c.cast("double") - OLD_ID) / ((NEW_ID - OLD_ID) / DAYS_BETWEEN)
    return F.timestamp_micros((F.lit(int(OLD_TIME.timestamp()) * 1_000_000) + days * 86400 * 1_000_000).cast("bigint"))


def rfc3339(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
