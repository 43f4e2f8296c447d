"""The read side: filtered, searched, ordered pages of postings with their total, and single postings."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.schema import EMPLOYMENT_TYPES, MARKETS, REMOTE_TYPES, UNCLASSIFIED, VERDICTS

PAGE, PAGE_SIZE, MOST = 1, 20, 100
LARGEST_OFFSET = (1 << 31) - 1
#: Companies and boards are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000


@dataclass
class Filter:
    query: str = ""
    company: str = ""
    tag: str = ""
    remote_type: str = ""
    employment_type: str = ""
    priority_only: bool = False
    market: str = ""
    eligibility: list[str] = field(default_factory=list)
    relevant_only: bool = False
    role_family: str = ""
    page: int = PAGE
    page_size: int = PAGE_SIZE
    max_age_seconds: int = 0


def parse_filter(params: Mapping[str, str]) -> Filter:
    """A filter from request parameters. Bad values are errors; false and blank are as if they were not given."""
    out = Filter(query=params.get("q", "").strip(), company=params.get("company", "").strip(), tag=params.get("tag", "").strip())

    def choice(name: str, values: tuple[str, ...]) -> str:
        value = params.get(name, "")
        if value and value not in values:
            raise ValueError(f"{name} must be one of {', '.join(values)} (got {value!r})")
        return value

    def number(name: str, default: int, most: int | None) -> int:
        value = params.get(name, "")
        if not value:
            return default
        if not re.fullmatch(r"[+-]?\d+", value) or int(value) < 1 or most is not None and int(value) > most:
            raise ValueError(f"{name} must be a whole number from 1{f' to {most}' if most else ''} (got {value!r})")
        return int(value)

    out.remote_type = choice("remote_type", REMOTE_TYPES)
    out.employment_type = choice("employment_type", EMPLOYMENT_TYPES)
    out.market = choice("market", MARKETS)
    out.priority_only = choice("priority", ("true", "false")) == "true"
    out.relevant_only = choice("relevant", ("true", "false")) == "true"
    if params.get("eligibility"):
        for part in (p.strip() for p in params["eligibility"].split(",")):
            if part not in (*VERDICTS, UNCLASSIFIED):
                raise ValueError(f"eligibility must list {', '.join((*VERDICTS, UNCLASSIFIED))} (got {part!r})")
            if part not in out.eligibility:
                out.eligibility.append(part)
    family = params.get("role_family", "")
    if family and not re.fullmatch(r"[a-z_]{1,40}", family):
        raise ValueError(f"role_family must be lower-case letters and underscores (got {family!r})")
    out.role_family = family
    out.page, out.page_size = number("page", PAGE, None), number("page_size", PAGE_SIZE, MOST)
    return out


def is_open(as_of: datetime) -> Column:
    return (F.col("status") == "open") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp")))


def joined(jobs: DataFrame, companies: DataFrame, targets: DataFrame, verdicts: DataFrame | None, small: bool = True) -> DataFrame:
    """Postings with their company, board and verdict. small: companies and targets are known to have at most BROADCAST_ROWS
    rows (see sized)."""
    side = F.broadcast if small else lambda df: df
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), F.col("website").alias("company_website"), "is_priority")
    t = targets.select(F.col("id").alias("target_company_id"), F.col("market").alias("board_market"))
    out = jobs.join(side(c), "company_id").join(side(t), "target_company_id")
    out = out.withColumn("market", F.when(F.col("is_priority"), "ethiopia").otherwise(F.col("board_market"))).drop("board_market")
    out = out.withColumn("posted_at", F.coalesce("published_at", "first_seen_at"))
    return out if verdicts is None else with_verdicts(out, verdicts)


def with_verdicts(rows: DataFrame, verdicts: DataFrame, few: bool = False) -> DataFrame:
    """rows with their verdict, if they have one. few: rows are a page, which is sent to the verdicts instead."""
    if few:
        verdicts = verdicts.join(F.broadcast(rows.select(F.col("id").alias("job_id"))), "job_id", "left_semi")
    v = verdicts.select(F.col("job_id").alias("id"), F.struct(F.col("status"), F.col("confidence").cast("double").alias("confidence"), "basis", "reasons", "evidence", "restrictions", "hours_constraint", *(c for c in ("detected_locations", "classifier_version") if c in verdicts.columns)).alias("eligibility"), "relevant", "role_family")
    return rows.join(F.broadcast(v) if few else v, "id", "left")


def asks_for_verdicts(f: Filter) -> bool:
    return bool(f.eligibility or f.relevant_only or f.role_family)


def sized(companies: DataFrame, targets: DataFrame) -> bool:
    """Whether companies and targets are few enough to broadcast."""
    return companies.count() <= BROADCAST_ROWS and targets.count() <= BROADCAST_ROWS


def matches(f: Filter, as_of: datetime) -> Column:
    """The filter over joined rows; null verdicts are unclassified, and never relevant."""
    conditions = [is_open(as_of)]
    if f.max_age_seconds > 0:
        conditions.append(F.col("posted_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(f.max_age_seconds)))
    for name in ("remote_type", "employment_type", "market"):
        if getattr(f, name):
            conditions.append(F.col(name) == getattr(f, name))
    if f.company:
        conditions.append(F.lower("company") == f.company.lower())
    if f.priority_only:
        conditions.append(F.col("is_priority"))
    if f.eligibility:
        conditions.append(F.coalesce(F.col("eligibility.status"), F.lit(UNCLASSIFIED)).isin(*f.eligibility))
    if f.relevant_only:
        conditions.append(F.col("relevant"))
    if f.role_family:
        conditions.append(F.col("role_family") == f.role_family)
    if f.query:
        conditions.append(F.lower("title").contains(f.query.lower()) | F.lower("company").contains(f.query.lower()))
    if f.tag:  # postings have no tags
        conditions.append(F.lit(False))
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def page_of(found: DataFrame, f: Filter) -> DataFrame:
    """One page of found, newest first, with the total on every row. A page past the end has no rows; ask total_of then."""
    offset = (f.page - 1) * f.page_size
    if offset > LARGEST_OFFSET:
        page = found.limit(0)
    else:
        page = found.orderBy(F.desc("posted_at"), F.desc("id")).offset(offset).limit(f.page_size)
    return page.crossJoin(F.broadcast(total_of(found)))  # one row


def total_of(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total"))


class JobsRepository:
    """List and get over the stored tables. Verdicts are joined before the filter only if it asks for them; else they are
    looked up for the page's rows, so that neither the count nor the ordering carries them."""

    def __init__(self, jobs: DataFrame, companies: DataFrame, targets: DataFrame, verdicts: DataFrame):
        self.bare, self.verdicts = joined(jobs, companies, targets, None, sized(companies, targets)), verdicts

    @property
    def rows(self) -> DataFrame:
        return with_verdicts(self.bare, self.verdicts)

    def found(self, f: Filter, as_of: datetime) -> DataFrame:
        return (self.rows if asks_for_verdicts(f) else self.bare).where(matches(f, as_of))

    def list(self, f: Filter, as_of: datetime) -> DataFrame:
        page = page_of(self.found(f, as_of), f)
        return page if asks_for_verdicts(f) else with_verdicts(page, self.verdicts, few=True)

    def total(self, f: Filter, as_of: datetime) -> DataFrame:
        return total_of(self.found(f, as_of))

    def get(self, job_id: str, as_of: datetime) -> DataFrame:
        """The visible posting with this identifier; none for what is no number."""
        return self.rows.where(is_open(as_of) & (F.col("id") == F.lit(job_id).try_cast("bigint")))
