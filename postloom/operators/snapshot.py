"""Changes to tables kept as snapshots: each operator takes the stored rows and what arrives, and returns the new rows.

An upsert is one full outer join on the key. Keys in the stored table are unique; of arriving rows with one key the last by
ord counts. New identifiers follow the largest stored one by the rank of the key, with ranks taken per hash range, so that no
task numbers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.names import company_key
from postloom.functions.text import blank_to_null, content_hash, trim_space
from postloom.schema import split_by

#: Parts in which new rows are numbered, at least, and rows of one part, about.
PARTS, ROWS_OF_A_PART = 64, 250_000


def last_of(batch: DataFrame, *keys: str | Column, order: str = "ord") -> DataFrame:
    """The last row of each key, by order."""
    by = Window.partitionBy(*keys).orderBy(F.desc(order))
    return batch.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")


def with_new_ids(rows: DataFrame, start: int, most: int, *keys: str) -> DataFrame:
    """rows whose id is null with ids from start + 1 on: gapless, by hash range and then by key. There are at most `most` new
    rows; the number of ranges follows it."""
    part = F.pmod(F.xxhash64(*keys), F.lit(max(PARTS, -(-most // ROWS_OF_A_PART))))
    new, old = rows.where("id is null").withColumn("_part", part), rows.where("id is not null")
    sizes = new.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    new = new.join(F.broadcast(offsets), "_part").withColumn("id", F.lit(start) + F.col("_before") + place)
    return old.unionByName(new.select(old.columns))


@dataclass
class Upserted:
    """rows: the new snapshot; outcomes: what happened to each arriving row; rejects: rows refused, with reasons."""

    rows: DataFrame
    outcomes: DataFrame
    rejects: DataFrame
    both: DataFrame  # rows with _outcome

    def written(self, path: str) -> Upserted:
        """The same over one table at path, so that the join runs once although rows and outcomes are both used."""
        self.both.write.mode("overwrite").parquet(path)
        return upserted(self.both.sparkSession.read.schema(self.both.schema).parquet(path), self.rejects)


def upserted(both: DataFrame, rejects: DataFrame) -> Upserted:
    outcomes = both.where("_outcome is not null").select("source", "source_job_id", "id", F.col("_outcome").alias("outcome"))
    return Upserted(both.drop("_outcome"), outcomes, rejects, both)


def upsert_jobs(stored: DataFrame, batch: DataFrame, now: datetime) -> Upserted:
    """Upsert postings by (source, source_job_id).

    batch: company_id, target_company_id, source, source_job_id, canonical_url, title, description, application_url,
    location_raw, published_at, expires_at, remote_type, employment_type, ord. A posting stored under another target or
    company is not changed, and its outcome is mismatch. Texts are replaced; dates and types that say nothing keep what is
    stored; a posting that was closed opens again and counts as changed.
    """
    at = F.lit(now).cast("timestamp")
    batch, rejects = split_by(batch, {name: F.coalesce(F.btrim(F.col(name)) != "", F.lit(False)) for name in ("source", "source_job_id", "title")})
    b = last_of(batch, "source", "source_job_id").select(
        "source", "source_job_id", "company_id", "target_company_id", F.nullif(F.col("canonical_url"), F.lit("")).alias("canonical_url"), "title", "description", "application_url",
        F.nullif(F.col("location_raw"), F.lit("")).alias("location_raw"), "published_at", "expires_at", F.nullif(F.col("remote_type"), F.lit("")).alias("remote_type"), F.nullif(F.col("employment_type"), F.lit("")).alias("employment_type"),
    )
    b = b.withColumn("content_hash", content_hash(*(F.col(c) for c in ("title", "description", "application_url", "canonical_url", "location_raw", "remote_type", "employment_type"))))
    j = stored.alias("o").join(b.alias("n"), (F.col("o.source") == F.col("n.source")) & (F.col("o.source_job_id") == F.col("n.source_job_id")), "full")
    arrived, known = F.col("n.source").isNotNull(), F.col("o.id").isNotNull()
    fits = arrived & known & (F.col("o.target_company_id") == F.col("n.target_company_id")) & (F.col("o.company_id") == F.col("n.company_id"))
    fresh = arrived & ~known
    differs = ~F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))
    changed = fits & (differs | (F.col("o.status") != "open"))

    def value(name: str) -> Column:
        o, n = (F.col(f"{side}.{name}") if name in columns else F.lit(None) for side, columns in (("o", stored.columns), ("n", b.columns)))
        if name in ("title", "description", "application_url", "location_raw", "canonical_url", "content_hash"):
            return F.when(fits | fresh, n).otherwise(o)
        if name in ("published_at", "expires_at"):
            return F.when(fits | fresh, F.coalesce(n, o)).otherwise(o)
        if name in ("remote_type", "employment_type"):
            return F.when(fresh, F.coalesce(n, F.lit("unknown"))).when(fits, F.coalesce(n, o)).otherwise(o)
        if name in ("source", "source_job_id", "company_id", "target_company_id"):
            return F.coalesce(o, n)
        if name in ("first_seen_at", "created_at"):
            return F.when(fresh, at).otherwise(o)
        if name == "last_seen_at":
            return F.when(fits | fresh, at).otherwise(o)
        if name == "last_changed_at":
            return F.when(fresh | changed, at).otherwise(o)
        if name == "status":
            return F.when(fits | fresh, F.lit("open")).otherwise(o)
        if name == "closed_at":
            return F.when(fits | fresh, F.lit(None).cast("timestamp")).otherwise(o)
        if name == "updated_at":  # last_seen_at always moves
            return F.when(fits | fresh, at).otherwise(o)
        return o

    outcome = F.when(fresh, "inserted").when(~fits, "mismatch").when(changed, "changed").otherwise("unchanged")
    joined = j.select(*(value(c).alias(c) for c in stored.columns), F.when(arrived, outcome).alias("_outcome"))
    start = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return upserted(with_new_ids(joined, start, batch.count(), "source", "source_job_id"), rejects)


def _close(rows: DataFrame, condition: Column, status: str, now: datetime) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    hit = (F.col("status") == "open") & F.coalesce(condition, F.lit(False))
    changes = {"status": F.when(hit, status).otherwise(F.col("status")), "closed_at": F.when(hit, at).otherwise(F.col("closed_at")), "updated_at": F.when(hit, at).otherwise(F.col("updated_at"))}
    return rows.select(*(changes.get(c, F.col(c)).alias(c) for c in rows.columns))


def _of(stored: DataFrame, targets: list[int] | DataFrame) -> DataFrame:
    """stored with _of: whether the posting's target is among targets, a short list or a table (target_company_id)."""
    if isinstance(targets, list):
        return stored.withColumn("_of", F.col("target_company_id").isin(*targets))
    own = targets.select("target_company_id").distinct().withColumn("_of", F.lit(True))
    return stored.join(own, "target_company_id", "left").select(*stored.columns, F.coalesce("_of", F.lit(False)).alias("_of"))


def mark_missing(stored: DataFrame, seen: DataFrame, targets: list[int] | DataFrame, now: datetime, fetched: bool = True) -> DataFrame:
    """Open postings of the targets (whose full listing was fetched) that seen (target_company_id, source_job_id) lacks are
    removed; an empty listing removes all. A listing that could not be fetched must not close anything."""
    if not fetched:
        raise ValueError("a listing that was not fetched says nothing about what is missing")
    key = ["target_company_id", "source_job_id"]
    marked = stored.join(seen.select(*key).distinct().withColumn("_seen", F.lit(True)), key, "left").select(*stored.columns, "_seen")
    return _close(_of(marked, targets), F.col("_of") & F.col("_seen").isNull(), "removed", now).drop("_seen", "_of")


def close_stale(stored: DataFrame, window_seconds: int, now: datetime, targets: list[int] | DataFrame | None = None) -> DataFrame:
    """Open postings last seen before the window are closed."""
    if window_seconds <= 0:
        raise ValueError("the window must be above 0")
    old = F.col("last_seen_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(window_seconds))
    if targets is None:
        return _close(stored, old, "closed", now)
    return _close(_of(stored, targets), old & F.col("_of"), "closed", now).drop("_of")


def close_by_id(stored: DataFrame, ended: DataFrame, now: datetime) -> DataFrame:
    """Open postings in ended (target_company_id, source_job_id) are closed."""
    key = ["target_company_id", "source_job_id"]
    marked = stored.join(ended.select(*key).distinct().withColumn("_ended", F.lit(True)), key, "left").select(*stored.columns, "_ended")
    return _close(marked, F.col("_ended"), "closed", now).drop("_ended")


def move_jobs(stored: DataFrame, moves: DataFrame, now: datetime) -> DataFrame:
    """Give postings in moves (source, source_job_id, target_company_id, company_id) to another target and company. updated_at
    moves with those that go elsewhere."""
    m = last_of(moves.withColumn("ord", F.lit(0)) if "ord" not in moves.columns else moves, "source", "source_job_id").alias("m")
    j = stored.alias("o").join(m, (F.col("o.source") == F.col("m.source")) & (F.col("o.source_job_id") == F.col("m.source_job_id")), "left")
    moved = F.col("m.source").isNotNull() & ~(F.col("m.target_company_id").eqNullSafe(F.col("o.target_company_id")) & F.col("m.company_id").eqNullSafe(F.col("o.company_id")))
    new = {"target_company_id": F.coalesce("m.target_company_id", "o.target_company_id"), "company_id": F.coalesce("m.company_id", "o.company_id"), "updated_at": F.when(moved, F.lit(now).cast("timestamp")).otherwise(F.col("o.updated_at"))}
    return j.select(*(new.get(c, F.col(f"o.{c}")).alias(c) for c in stored.columns))


def upsert_companies(stored: DataFrame, batch: DataFrame, now: datetime) -> DataFrame:
    """Upsert companies by name, ignoring case and outer spaces: missing websites and descriptions are filled in, what is
    there stays. batch: name, website, description, ord; rows without a name are left out."""
    at = F.lit(now).cast("timestamp")
    b = batch.select(trim_space(F.col("name")).alias("name"), blank_to_null(F.col("website")).alias("website"), blank_to_null(F.col("description")).alias("description"), "ord").where("name <> ''")
    # rows with one name in one batch act one after the other: the first to say something wins
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord")))
    b = b.groupBy(company_key(F.col("name")).alias("_key")).agg(F.min_by("name", "ord").alias("name"), first("website").alias("website"), first("description").alias("description"))
    j = stored.withColumn("_key", company_key(F.col("name"))).alias("o").join(b.alias("n"), F.col("o._key") == F.col("n._key"), "full")
    fresh = F.col("o.id").isNull()
    grown = ~fresh & ((F.col("o.website").isNull() & F.col("n.website").isNotNull()) | (F.col("o.description").isNull() & F.col("n.description").isNotNull()))
    new = {
        "name": F.coalesce("o.name", "n.name"),
        "website": F.coalesce("o.website", "n.website"),
        "description": F.coalesce("o.description", "n.description"),
        "status": F.coalesce("o.status", F.lit("active")),
        "is_priority": F.coalesce("o.is_priority", F.lit(False)),
        "created_at": F.coalesce("o.created_at", at),
        "updated_at": F.when(fresh | grown, at).otherwise(F.col("o.updated_at")),
    }
    start = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return with_new_ids(j.select(*(new.get(c, F.col(f"o.{c}")).alias(c) for c in stored.columns)), start, batch.count(), "name")


def upsert_targets(stored: DataFrame, batch: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Upsert boards by (provider, board): the new rows, and the arriving rows whose board belongs to another company.

    batch: company_id, ats_provider, external_board_id, board_url, discovery_metadata (null keeps what is stored, an empty map
    replaces it), market (blank keeps), ord.
    """
    at = F.lit(now).cast("timestamp")
    key = lambda c: F.lower(F.btrim(c))
    b = batch.select("company_id", trim_space(F.col("ats_provider")).alias("ats_provider"), trim_space(F.col("external_board_id")).alias("external_board_id"), blank_to_null(F.col("board_url")).alias("board_url"), "discovery_metadata", blank_to_null(F.col("market")).alias("market"), "ord")
    b = last_of(b.where("company_id > 0 and ats_provider <> '' and external_board_id <> ''").withColumn("_key", key(F.col("external_board_id"))), "ats_provider", "_key")
    o = stored.withColumn("_key", key(F.col("external_board_id")))
    j = o.alias("o").join(b.alias("n"), (F.col("o.ats_provider") == F.col("n.ats_provider")) & (F.col("o._key") == F.col("n._key")), "full")
    fresh, arrived = F.col("o.id").isNull(), F.col("n._key").isNotNull()
    fits = ~fresh & arrived & (F.col("o.company_id") == F.col("n.company_id"))
    pick = lambda c: F.when(fits | fresh, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}"))
    after = {
        "company_id": F.coalesce("o.company_id", "n.company_id"),
        "ats_provider": F.coalesce("o.ats_provider", "n.ats_provider"),
        "external_board_id": F.coalesce("o.external_board_id", "n.external_board_id"),
        "board_url": pick("board_url"),
        "discovery_metadata": F.coalesce(pick("discovery_metadata"), F.create_map().cast("map<string,string>")),
        "is_active": F.when(fits | fresh, True).otherwise(F.col("o.is_active")),
        "market": F.coalesce(pick("market"), F.lit("worldwide")),
        "created_at": F.coalesce("o.created_at", at),
    }
    changed = fits & ~(F.col("o.is_active") & F.col("o.board_url").eqNullSafe(after["board_url"]) & F.col("o.market").eqNullSafe(after["market"]) & F.map_entries("o.discovery_metadata").eqNullSafe(F.map_entries(after["discovery_metadata"])))
    after["updated_at"] = F.when(fresh | changed, at).otherwise(F.col("o.updated_at"))
    rows = j.select(*(after.get(c, F.col(f"o.{c}")).alias(c) for c in stored.columns))
    start = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    mismatches = j.where(arrived & ~fresh & ~fits).select("n.company_id", "n.ats_provider", "n.external_board_id", F.col("o.company_id").alias("owner_id"))
    return with_new_ids(rows, start, batch.count(), "ats_provider", "external_board_id"), mismatches


def set_column(stored: DataFrame, changes: DataFrame, column: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Set one column by id from changes (id, value): the new rows, and the changes whose id is not stored."""
    c = changes.select(F.col("id").alias("_id"), F.col("value").alias("_value"))
    j = stored.join(c, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    differs = hit & ~F.col(column).eqNullSafe(F.col("_value"))
    new = {column: F.when(hit, F.col("_value")).otherwise(F.col(column)), "updated_at": F.when(differs, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))}
    return j.select(*(new.get(x, F.col(x)).alias(x) for x in stored.columns)), changes.join(stored.select("id"), "id", "left_anti")


def record_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest run of each collector; names are trimmed, blank ones left out."""
    both = log.select("name", "last_run_at").unionByName(runs.select("name", "last_run_at"))
    return both.withColumn("name", trim_space(F.col("name"))).where("name <> ''").groupBy("name").agg(F.max("last_run_at").alias("last_run_at"))


def save_verdicts(stored: DataFrame, verdicts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Verdicts by job_id: what arrives replaces what is stored, and only for jobs that exist."""
    arriving = last_of(verdicts, "job_id").join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return stored.join(arriving.select("job_id"), "job_id", "left_anti").unionByName(arriving.select(stored.columns))
