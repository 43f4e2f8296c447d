"""From postings as sources list them to stored rows: employers, duplicates, what counts as seen, and what is closed.

Postings are rows of schema.ATS_JOB. Order-dependent rules use ord, the place of a posting in its source's answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.names import name_key, title_key
from postloom.functions.places import city_key, has_city, in_ethiopia, same_place
from postloom.functions.text import collapse_space, truncate
from postloom.operators import snapshot

TITLE_LENGTH = 300
FUTURE = timedelta(hours=24)
GRACE = timedelta(minutes=10)
#: Known names are few (a configured list); other tables are broadcast only below this many rows.
BROADCAST_ROWS = 100_000


def name_table(companies: DataFrame) -> DataFrame:
    """(key, canonical) from companies (name, aliases, ord): of names with one key the first counts."""
    names = companies.select("name", "ord", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "spelling"))
    keyed = names.withColumn("key", name_key(F.col("spelling"))).where("key <> ''")
    return keyed.groupBy("key").agg(F.min_by("name", F.struct("ord", "at")).alias("canonical"))


def resolve(rows: DataFrame, names: DataFrame, column: str = "employer") -> DataFrame:
    """rows with canonical, the known company an employer names; null if none."""
    side = F.broadcast(names) if names.count() <= BROADCAST_ROWS else names
    return rows.withColumn("_key", name_key(F.col(column))).join(side.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def by_employer(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with an employer, and their group: canonical, priority (a known company), employer_key, group_ord (where the
    group first occurs) and all_closed (none of its postings is open, so it must not become a company)."""
    named = rows.withColumn("employer", collapse_space(F.col("employer"))).where("employer <> ''")
    found = resolve(named, names).withColumn("priority", F.col("canonical").isNotNull()).withColumn("canonical", F.coalesce("canonical", "employer"))
    keyed = found.withColumn("employer_key", F.lower("canonical"))
    groups = keyed.groupBy("employer_key").agg(F.min("ord").alias("group_ord"), F.bool_and("closed").alias("all_closed"), F.min_by("canonical", "ord").alias("group_name"))
    return keyed.join(groups, "employer_key").withColumn("canonical", F.col("group_name")).drop("group_name")


def first_of(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """The first posting of each key, by ord."""
    by = Window.partitionBy(*keys).orderBy("ord")
    return rows.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")


def dedupe_results(rows: DataFrame) -> DataFrame:
    """rows with dropped, for postings of one search: of one employer and title the first of each city stays, and the first
    without a city unless a kept one is in the home country. Closed postings stay and drop nothing."""
    keyed = rows.withColumn("_n", name_key(F.col("employer"))).withColumn("_t", title_key(F.col("title"))).withColumn("_c", city_key(F.col("location_raw")))
    city = Window.partitionBy("_n", "_t", "_c", "closed").orderBy("ord")
    placed = keyed.withColumn("_place", F.row_number().over(city))
    home = F.max(F.when(~F.col("closed") & (F.col("_c") != "") & (F.col("_place") == 1), in_ethiopia(F.col("location_raw")))).over(Window.partitionBy("_n", "_t"))
    dropped = ~F.col("closed") & ((F.col("_place") > 1) | ((F.col("_c") == "") & F.coalesce(home, F.lit(False))))
    return placed.withColumn("dropped", dropped).drop("_n", "_t", "_c", "_place")


def drop_known(rows: DataFrame, known: DataFrame, market: str, keys: tuple[str, ...] = ("company_id",)) -> DataFrame:
    """Open postings whose opening is not in known (keys, title, location_raw): the same title at the same employer, and in
    the home market also possibly the same place. Closed ones stay."""
    k = known.select(*(F.col(c).alias(f"_{c}") for c in keys), title_key(F.col("title")).alias("_title"), F.col("location_raw").alias("_location")).distinct()
    on = ~F.col("closed") & (title_key(F.col("title")) == F.col("_title"))
    for c in keys:
        on = on & (F.col(c) == F.col(f"_{c}"))
    if market != "worldwide":
        on = on & same_place(F.col("location_raw"), F.col("_location"))
    return rows.join(k, on, "left_anti")


@dataclass
class Prepared:
    """records: to upsert; seen and ended: identifiers listed, and reported as ended; skipped: listed but unusable."""

    records: DataFrame
    seen: DataFrame
    ended: DataFrame
    skipped: DataFrame


def prepare(rows: DataFrame, now: datetime) -> Prepared:
    """Split postings (with company_id and target_company_id). A publish date from the future is forgotten; every open
    posting counts as seen, also one that cannot be stored."""
    key = ["target_company_id", F.col("external_id").alias("source_job_id")]
    ended = rows.where("closed and external_id <> ''").select(*key)
    live = rows.where("not coalesce(closed, false)")
    late = F.lit(now + FUTURE).cast("timestamp")
    live = live.withColumn("published_at", F.when(F.col("published_at") <= late, F.col("published_at"))).withColumn("title", truncate(F.col("title"), TITLE_LENGTH))
    usable = F.coalesce((F.col("external_id") != "") & (F.col("title") != "") & (F.col("url") != ""), F.lit(False))
    records = live.where(usable).select(
        "company_id", "target_company_id", "source", F.col("external_id").alias("source_job_id"), F.lit("").alias("canonical_url"), "title", F.coalesce("description", F.lit("")).alias("description"),
        F.col("url").alias("application_url"), "location_raw", "published_at", "expires_at", "remote_type", "employment_type", "ord",
    )
    return Prepared(records, live.select(*key), ended, live.where(~usable))


@dataclass
class Ingested:
    rows: DataFrame
    outcomes: DataFrame
    skipped: DataFrame


def ingest(stored: DataFrame, rows: DataFrame, targets: list[int] | DataFrame, now: datetime, stale_seconds: int = 0, movable: bool = False, work_path: str | None = None) -> Ingested:
    """Store what the targets list and close what they no longer do.

    A full listing (stale_seconds = 0) closes what it lacks; a sample closes what was not seen for so long. movable: postings
    stored under another company move here first, as their employer was renamed. targets: a short list or a table
    (target_company_id). With a work_path the upsert is written there once; else rows and outcomes each run it.
    """
    p = prepare(rows, now)
    if movable:
        owners = stored.select("source", "source_job_id", F.col("target_company_id").alias("_t"), F.col("company_id").alias("_c"))
        moves = p.records.join(owners, ["source", "source_job_id"]).where("_t <> target_company_id or _c <> company_id")
        stored = snapshot.move_jobs(stored, moves.select("source", "source_job_id", "target_company_id", "company_id", "ord"), now)
    up = snapshot.upsert_jobs(stored, p.records, now)
    up = up.written(work_path) if work_path else up
    out = snapshot.close_by_id(up.rows, p.ended, now)
    if stale_seconds > 0:
        out = snapshot.close_stale(out, stale_seconds, now, targets)
    else:
        out = snapshot.mark_missing(out, p.seen, targets, now)
    return Ingested(out, up.outcomes, p.skipped)


def sweep_absent(stored: DataFrame, targets: DataFrame, touched: DataFrame, provider: str, stale_seconds: int, now: datetime) -> DataFrame:
    """Age out postings of a collector's active targets (id, ats_provider, is_active) that this run did not touch (id)."""
    absent = targets.where((F.col("ats_provider") == provider) & F.col("is_active")).join(touched.select("id"), "id", "left_anti")
    marked = stored.join(absent.select(F.col("id").alias("target_company_id"), F.lit(True).alias("_absent")), "target_company_id", "left").select(*stored.columns, "_absent")
    old = F.col("_absent") & (F.col("last_seen_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(stale_seconds)))
    return snapshot._close(marked, old, "closed", now).drop("_absent")


def retire_board(stored: DataFrame, targets: DataFrame, target_id: int, now: datetime) -> tuple[DataFrame, DataFrame]:
    """A board that is gone: its postings are removed and it is no longer active."""
    jobs = snapshot.mark_missing(stored, stored.limit(0), [target_id], now)
    change = stored.sparkSession.createDataFrame([(target_id, False)], "id bigint, value boolean")
    return jobs, snapshot.set_column(targets, change, "is_active", now)[0]


def is_due(log: DataFrame, name: str, now: datetime, least: timedelta) -> bool:
    """Whether a collector's last run is long enough ago; attempts count as runs."""
    last = log.where(F.trim(F.col("name")) == name.strip()).agg(F.max("last_run_at")).first()[0]
    return last is None or now - last >= least - GRACE


def route(provider: str, market: str, priority: Column, priority_provider: str) -> tuple[Column, Column]:
    """Provider and market under which an employer's postings are stored."""
    other = priority & F.lit(priority_provider != "")
    return F.when(other, priority_provider).otherwise(provider), F.when(other, "ethiopia").otherwise(market)


def dedupe_across(collected: list[tuple[str, DataFrame]], market: str) -> list[tuple[str, DataFrame]]:
    """Each collector's postings (with employer_key) without openings that an earlier collector of this run has stored."""
    out, stored = [], None
    for name, rows in collected:
        fresh = rows if stored is None else drop_known(rows, stored, market, ("employer_key",))
        out.append((name, fresh))
        live = fresh.where("not closed").select("employer_key", "title", "location_raw")
        stored = live if stored is None else stored.unionByName(live)
    return out


def has_named_city(rows: DataFrame) -> DataFrame:
    return rows.where(has_city(F.col("location_raw")))


@dataclass
class Collected:
    """What one collector or board gave: its rows, and the error it ended with, if any. partial: the rows before the error
    are good, and only closing by absence is out of the question."""

    name: str
    rows: DataFrame | None
    error: str | None = None
    partial: bool = False

    @property
    def usable(self) -> bool:
        return self.rows is not None and (self.error is None or self.partial)


def run_report(results: DataFrame) -> DataFrame:
    """One row over results (name, error, inserted, changed, unchanged, skipped, removed): how many ended well and failed, the
    sums of those that ended well, and all_failed, which fails a run. Partial results count as failed, their rows count."""
    counts = [F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("bigint").alias(c) for c in ("inserted", "changed", "unchanged", "skipped", "removed")]
    good = F.count_if(F.col("error").isNull())
    return results.agg(good.alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), *counts, ((F.count(F.lit(1)) > 0) & (good == 0)).alias("all_failed"))
