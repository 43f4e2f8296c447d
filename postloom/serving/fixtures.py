"""Made-up postings to try the read interface with, without a warehouse."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.listing import Filter, JobsRepository, matches

ROWS = (
    ("Orchard keeper", "Green Hollow", "hybrid", "full_time", "Nairobi", ("plants", "outdoors"), "2026-06-12"),
    ("Backend developer", "Tin Whistle", "remote", "full_time", "Worldwide", ("go", "spark"), "2026-06-11"),
    ("Data engineer", "Tin Whistle", "remote", "contract", "EMEA", ("spark", "sql"), "2026-06-11"),
    ("Night baker", "Old Mill", "hybrid", "part_time", "Adama", ("bread",), "2026-06-10"),
    ("Illustrator", "Paper Boat", "remote", "contract", "Worldwide", ("art",), "2026-06-09"),
    ("Support agent", "Paper Boat", "remote", "part_time", "Africa", ("support", "email"), "2026-06-08"),
    ("Reliability engineer", "Quiet Harbour", "remote", "full_time", "Europe", ("linux", "go"), "2026-06-07"),
    ("Copy editor", "Quiet Harbour", "remote", "contract", "Americas", ("text",), "2026-06-05"),
    ("Trainee surveyor", "Long Rope", "hybrid", "internship", "Kampala", ("maps",), "2026-06-04"),
    ("Map designer", "Long Rope", "remote", "full_time", "Worldwide", ("maps", "art"), "2026-06-03"),
    ("Bookkeeper", "Old Mill", "hybrid", "part_time", "Adama", ("numbers",), "2026-06-02"),
    ("Research intern", "Green Hollow", "remote", "internship", "Worldwide", ("plants", "text"), "2026-06-01"),
)
SCHEMA = (
    "id bigint, source string, source_job_id string, title string, company string, is_priority boolean, market string, remote_type string, employment_type string, location_raw string, tags array<string>, "
    "posted_at timestamp, application_url string, description string, status string, expires_at timestamp"
)


def fixture_rows(spark: SparkSession) -> DataFrame:
    rows = [
        (k, "fixtures", str(k), title, company, company == "Old Mill", "worldwide", remote, employment, place, list(tags), datetime.fromisoformat(day), f"https://{company.split()[0].lower()}.example/{k}", f"{title} at {company}.", "open", None)
        for k, (title, company, remote, employment, place, tags, day) in enumerate(ROWS, 1)
    ]
    empty = "CAST(NULL AS struct<status:string,confidence:double,basis:string,reasons:array<string>,evidence:array<struct<field:string,text:string>>,restrictions:array<string>,hours_constraint:string>) AS eligibility"
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", empty, "CAST(NULL AS boolean) AS relevant", "CAST(NULL AS string) AS role_family")


class FixtureRepository(JobsRepository):
    """The fixtures, with tags to filter and to search by. They have no verdicts, and filters for those are not applied."""

    def __init__(self, spark: SparkSession):
        self.bare = fixture_rows(spark)

    @property
    def rows(self) -> DataFrame:
        return self.bare

    def found(self, f: Filter, as_of: datetime) -> DataFrame:
        out = self.bare.where(matches(replace(f, query="", tag="", eligibility=[], relevant_only=False, role_family="", max_age_seconds=0), as_of))
        if f.tag:
            out = out.where(F.exists("tags", lambda t: F.lower(t) == f.tag.lower()))
        if f.query:
            has = lambda c: F.lower(c).contains(f.query.lower())
            out = out.where(has(F.col("title")) | has(F.col("company")) | F.exists("tags", has))
        return out

    def list(self, f: Filter, as_of: datetime) -> DataFrame:
        from postloom.operators.listing import page_of

        return page_of(self.found(f, as_of), f)
