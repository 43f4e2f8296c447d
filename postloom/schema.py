"""Tables, vocabularies and the expectations rows have to meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabularies of the tables.
REMOTE_TYPES = ("remote", "hybrid", "onsite", "unknown")
EMPLOYMENT_TYPES = ("full_time", "part_time", "contract", "internship", "unknown")
JOB_STATUSES = ("open", "closed", "removed")
COMPANY_STATUSES = ("active", "inactive")
VERDICTS = ("eligible", "ineligible", "uncertain")
UNCLASSIFIED = "unclassified"
MARKETS = ("ethiopia", "worldwide")

COMPANIES = "id bigint, name string, website string, description string, status string, is_priority boolean, created_at timestamp, updated_at timestamp"
TARGETS = "id bigint, company_id bigint, ats_provider string, external_board_id string, board_url string, discovery_metadata map<string,string>, is_active boolean, last_successful_ingestion_at timestamp, created_at timestamp, updated_at timestamp, market string"
JOBS = (
    "id bigint, company_id bigint, target_company_id bigint, source string, source_job_id string, canonical_url string, title string, description string, "
    "application_url string, location_raw string, remote_type string, employment_type string, published_at timestamp, first_seen_at timestamp, last_seen_at timestamp, "
    "last_changed_at timestamp, closed_at timestamp, expires_at timestamp, status string, content_hash string, created_at timestamp, updated_at timestamp"
)
RUNS = "name string, last_run_at timestamp"
ELIGIBILITY = (
    "job_id bigint, target_country string, status string, confidence decimal(3,2), basis string, reasons array<string>, evidence array<struct<field:string,text:string>>, "
    "detected_locations array<string>, restrictions array<string>, hours_constraint string, role_family string, relevant boolean, relevance_matched string, "
    "classifier_version int, job_content_hash string, classified_at timestamp"
)
#: One posting as a source gives it; ord orders postings: by answer, then by place in it.
ATS_JOB = (
    "source string, ord struct<answer:bigint,place:int>, external_id string, title string, url string, location_raw string, description string, published_at timestamp, expires_at timestamp, "
    "remote_type string, employment_type string, employer string, closed boolean"
)


def not_blank(name: str) -> Column:
    return F.coalesce(F.btrim(F.col(name)) != "", F.lit(False))


def one_of(name: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(name).isin(*values), F.lit(False))


def job_expectations() -> dict[str, Column]:
    ended = F.col("status").isin("closed", "removed")
    return {
        "source": not_blank("source"),
        "source_job_id": not_blank("source_job_id"),
        "title": not_blank("title"),
        "remote_type": one_of("remote_type", REMOTE_TYPES),
        "employment_type": one_of("employment_type", EMPLOYMENT_TYPES),
        "status": one_of("status", JOB_STATUSES),
        "seen_order": F.coalesce(F.col("last_seen_at") >= F.col("first_seen_at"), F.lit(False)),
        "closed_at": F.coalesce(ended == F.col("closed_at").isNotNull(), F.lit(False)),
    }


def eligibility_expectations() -> dict[str, Column]:
    return {"status": one_of("status", VERDICTS), "confidence": F.coalesce(F.col("confidence").between(0, 1), F.lit(False))}


def split_by(rows: DataFrame, expectations: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that meet all expectations, and the others with the names of those they break."""
    broken = F.filter(F.array(*(F.when(~c, F.lit(name)) for name, c in expectations.items())), lambda x: x.isNotNull())
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


class Orphans(ValueError):
    """Rows refer to rows that are not there. That is no bad record to skip but a fault of the run, which has to stop."""


def require_parents(rows: DataFrame, column: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """rows, if every value of the column that is not null is a key of parents; else Orphans."""
    lost = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_lost")).join(parents.select(F.col(key).alias("_lost")), "_lost", "left_anti").limit(3).collect()
    if lost:
        raise Orphans(f"{column} refers to rows that are not there, such as {', '.join(str(r[0]) for r in lost)}")
    return rows
