"""Search results as postings: rows (ord, url, title, snippet, date) to rows of schema.ATS_JOB, with the reason for the others.

Identifiers and titles come from the posting's URL, "<title>-at-<company>-<number>"; the result's own title gives back how
they are spelled. All expressions are native.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions import dates
from postloom.functions.names import is_placeholder_employer, name_key, slug
from postloom.functions.places import in_ethiopia, in_ethiopia_text, result_location
from postloom.functions.text import clean_text, collapse_space, trim_space

# The address of a posting in search results, and words of the longest title or name that is looked for.
URL = r"(?i)^https://(?:www|[a-z]{2,3})\.linkedin\.com/jobs/view/([a-z0-9-]+)-(\d{6,})/?$"
LONGEST_SPAN = 14


def spelled(words_of: Column, want: Column) -> Column:
    """The first and shortest run of words whose slug is wanted; null if there is none."""
    words = F.filter(F.split(collapse_space(F.coalesce(words_of, F.lit(""))), " "), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    spans = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_SPAN), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " "))))
    return F.get(F.filter(spans, lambda s: (want != "") & (slug(s) == want)), 0)


def capitalized(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000))), " ")


def splits(s: Column) -> Column:
    """(title, company) at every "-at-" that leaves a title, the last first."""
    parts = F.split(s, "-at-")
    places = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(places, lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "-at-").alias("title"), F.array_join(F.slice(parts, k + 1, F.size(parts) - k), "-at-").alias("company")))
    return F.filter(pairs, lambda p: p["title"] != "")


def results(rows: DataFrame, now: datetime, max_age: timedelta, accepted: list[str] | None = None, employer: str = "", anywhere: bool = False) -> DataFrame:
    """Postings with reason: null for a posting or closure marker, or why the result is none.

    accepted: name keys of the one company searched for, whose canonical name is employer; None takes any employer, from the
    result's title if it reads "<company> hiring", or else from the URL. Results that say the posting has ended, or that are
    too old by their date or their number, are closure markers. anywhere: places outside the home country are fine.
    """
    raw = F.substring_index(F.substring_index(trim_space(F.coalesce("url", F.lit(""))), "#", 1), "?", 1)
    title, snippet = F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))
    base = rows.select("ord", raw.alias("_url"), title.alias("_title"), snippet.alias("_snippet"), F.col("date").alias("_date"))
    base = base.withColumn("_slug", F.lower(F.regexp_extract("_url", URL, 1))).withColumn("_id", F.regexp_extract("_url", URL, 2)).withColumn("_splits", splits(F.col("_slug")))
    if accepted is not None:
        chosen = F.get(F.filter("_splits", lambda p: name_key(p["company"]).isin(*accepted)), 0)
        base = base.withColumn("_split", chosen).withColumn("_employer", F.lit(employer))
    else:
        before = F.when(F.col("_title").contains(" hiring "), F.substring_index("_title", " hiring ", 1)).otherwise("")
        named = F.get(F.filter("_splits", lambda p: (slug(before) != "") & (p["company"] == slug(before))), 0)
        last = F.get("_splits", 0)
        base = base.withColumn("_split", F.coalesce(named, F.when(last["company"] != "", last)))
        base = base.withColumn("_employer", clean_text(F.when(named.isNotNull(), before).otherwise(F.coalesce(spelled(F.col("_title"), F.col("_split.company")), capitalized(F.col("_split.company"))))))
    place = result_location(F.col("_title"), F.col("_snippet"))
    base = base.withColumn("_place", place)
    home = F.lower(F.col("_url")).startswith("https://et.") | in_ethiopia(F.col("_place")) | in_ethiopia_text(F.concat_ws(" ", "_snippet", "_title"))
    at = F.lit(now).cast("timestamp")
    oldest = F.lit(now - max_age).cast("timestamp")
    published = F.least(dates.posted_from_id(F.col("_id").try_cast("bigint")), at)
    old = F.coalesce(dates.relative_date(F.col("_date"), at) < oldest, F.lit(False)) | F.coalesce(published < oldest, F.lit(False))
    ended = F.lower("_snippet").contains("no longer accepting applications")
    fits = F.lit(True) if anywhere else home
    who = F.col("_employer")
    no_employer = F.lit(False) if accepted is not None else (F.coalesce(who, F.lit("")) == "") | (F.length(who) > 200) | is_placeholder_employer(who)
    split_reason = "other-company" if accepted is not None else "no-employer"
    reason = F.when(F.col("_id") == "", "not-a-job-url").when(F.col("_split").isNull(), split_reason).when(F.coalesce(no_employer, F.lit(True)), "no-employer").when(~ended & ~fits, "outside-ethiopia")
    # columns of their own, which are worked out once and not in every column that asks for them
    base = base.withColumns({"_reason": reason, "_over": ended | old, "_published": published})
    reason, published = F.col("_reason"), F.col("_published")
    base = base.withColumn("_closed", reason.isNull() & F.col("_over"))
    # and through a generator, past which no filter on them is pushed: it would hold all of the above in place of the columns
    decided = F.explode(F.array(F.struct("_reason", "_closed", "_published", "_employer")))
    base = base.select("ord", "_url", "_title", "_snippet", "_id", "_split", "_place", decided.alias("_decided")).select("*", "_decided.*")
    closed = F.col("_closed")
    live = lambda c: F.when(reason.isNull() & ~closed, c).otherwise(F.lit(""))
    name = clean_text(F.coalesce(spelled(F.col("_title"), F.col("_split.title")), capitalized(F.col("_split.title"))))
    return base.select(
        F.lit("search").alias("source"), "ord", F.concat(F.lit("linkedin:"), "_id").alias("external_id"), live(name).alias("title"), live(F.col("_url")).alias("url"), live(F.col("_place")).alias("location_raw"),
        live(F.col("_snippet")).alias("description"), F.when(reason.isNull() & ~closed, published).alias("published_at"), F.lit(None).cast("timestamp").alias("expires_at"), F.lit("").alias("remote_type"),
        F.lit("").alias("employment_type"), F.coalesce(who, F.lit("")).alias("employer"), closed.alias("closed"), reason.alias("reason"),
    )


def reasons(found: DataFrame) -> DataFrame:
    """How many results each reason ruled out."""
    return found.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("results"))


class BudgetSpent(Exception):
    """No search is left in the budget."""


class Unauthorized(Exception):
    """The search service does not take the key; trying again is no use."""


@dataclass
class Budget:
    """Searches that a run may make; every attempt is one, as a failed one may have been billed."""

    most: int
    used: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def take(self) -> None:
        with self.lock:
            if self.used >= self.most:
                raise BudgetSpent(f"all {self.most} searches of the budget are made")
            self.used += 1


def metered(budget: Budget, search: Callable[[], list], pause: Callable[[], None] = lambda: None, attempts: int = 2) -> list:
    """What the search gives. It is tried once more after a failure, but not with a key that is refused."""
    for left in reversed(range(attempts)):
        budget.take()
        try:
            return search()
        except Unauthorized:
            raise
        except Exception:
            if not left:
                raise
            pause()
    raise ValueError("attempts must be above 0")
