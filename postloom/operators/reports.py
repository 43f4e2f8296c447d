"""Counts and reports over postings, companies and verdicts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from postloom.operators.listing import is_open
from postloom.schema import UNCLASSIFIED

TITLES = 500


def eligibility_counts(jobs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Open postings by verdict; those without one are unclassified."""
    v = verdicts.select(F.col("job_id").alias("id"), F.col("status").alias("verdict"))
    return jobs.where("status = 'open'").select("id").join(v, "id", "left").groupBy(F.coalesce("verdict", F.lit(UNCLASSIFIED)).alias("status")).agg(F.count(F.lit(1)).alias("jobs"))


def pending_verdicts(jobs: DataFrame, verdicts: DataFrame, version: int, country: str, force: bool = False) -> DataFrame:
    """Open postings whose verdict is missing or was made by other rules, for another country or other content."""
    v = verdicts.select(F.col("job_id").alias("id"), "classifier_version", "target_country", "job_content_hash")
    current = (F.col("classifier_version") == version) & (F.col("target_country") == country) & F.col("job_content_hash").eqNullSafe(F.col("content_hash"))
    return jobs.where("status = 'open'").join(v, "id", "left").where(F.lit(force) | ~F.coalesce(current, F.lit(False))).select(jobs.columns)


def _with_provider(targets: DataFrame, providers: list[str], active: bool = False) -> DataFrame:
    chosen = targets.where(F.col("ats_provider").isin(*providers))
    return (chosen.where("is_active") if active else chosen).select(F.col("company_id").alias("id"))


def names_without_board(companies: DataFrame, targets: DataFrame, sources: list[str], boards: list[str]) -> DataFrame:
    """Companies that a source shows and that have no active board."""
    seen = companies.join(_with_provider(targets, sources), "id", "left_semi")
    return seen.join(_with_provider(targets, boards, True), "id", "left_anti").select("name").distinct()


def names_with_board(companies: DataFrame, targets: DataFrame, boards: list[str]) -> DataFrame:
    return companies.join(_with_provider(targets, boards, True), "id", "left_semi").select("name").distinct()


def names_with_source_and_board(companies: DataFrame, targets: DataFrame, sources: list[str], boards: list[str]) -> DataFrame:
    return names_with_board(companies.join(_with_provider(targets, sources), "id", "left_semi"), targets, boards)


def targets_of(companies: DataFrame, targets: DataFrame, names: list[str], providers: list[str]) -> DataFrame:
    """Boards of the named companies (ignoring case), ordered by company, provider and board."""
    c = companies.where(F.lower(F.btrim("name")).isin(*(n.strip().lower() for n in names))).select(F.col("id").alias("company_id"), F.col("name").alias("company"))
    return targets.where(F.col("ats_provider").isin(*providers)).join(c, "company_id").orderBy(F.lower("company"), "ats_provider", "external_board_id")


def open_openings(jobs: DataFrame, companies: DataFrame, targets: DataFrame, market: str, other_than: str, as_of: datetime) -> DataFrame:
    """Open postings of a market that come from other sources, by company."""
    c = companies.select(F.col("id").alias("company_id"), "is_priority")
    t = targets.select(F.col("id").alias("target_company_id"), F.col("market").alias("board_market"))
    rows = jobs.where(is_open(as_of) & (F.col("source") != other_than)).join(c, "company_id").join(t, "target_company_id")
    return rows.where(F.when(F.col("is_priority"), "ethiopia").otherwise(F.col("board_market")) == market).select("company_id", "id", "title", "location_raw")


def titles_by_company(jobs: DataFrame, companies: DataFrame, sources: list[str], most: int = TITLES) -> DataFrame:
    """The first distinct titles of each company, by title."""
    c = companies.select(F.col("id").alias("company_id"), F.lower("name").alias("company"))
    distinct = jobs.where(F.col("source").isin(*sources)).join(c, "company_id").select("company", "title").distinct()
    by = Window.partitionBy("company").orderBy("title")
    return distinct.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def coverage(jobs: DataFrame, companies: DataFrame, targets: DataFrame, as_of: datetime) -> DataFrame:
    """One row per priority company, by name: its open postings, by source, and the state of its boards, each as a line of
    text."""
    priority = companies.where("is_priority").select("id", "name")
    counts = jobs.where(is_open(as_of)).groupBy(F.col("company_id").alias("id"), "source").agg(F.count(F.lit(1)).alias("n"))
    by_source = counts.groupBy("id").agg(F.sum("n").alias("open_jobs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda s: F.concat(s["source"], F.lit("="), s["n"].cast("string"))), " ").alias("by_source"))
    state = F.when(~F.col("is_active"), "(inactive)").when(F.col("last_successful_ingestion_at").isNull(), "(never ingested)").otherwise("")
    boards = targets.groupBy(F.col("company_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ats_provider", "external_board_id", state.alias("state")))), lambda t: F.concat(t["ats_provider"], t["state"])), " ").alias("boards"))
    out = priority.join(by_source, "id", "left").join(boards, "id", "left")
    return out.select("name", F.coalesce("open_jobs", F.lit(0)).alias("open_jobs"), F.coalesce("by_source", F.lit("-")).alias("by_source"), F.coalesce("boards", F.lit("none")).alias("boards")).orderBy(F.lower("name"))


def coverage_text(rows: list[Row], headline: Row) -> str:
    """The report as text: a line for each company, in columns, and the headline. rows: the priority list, which is short."""
    cells = [("company", "open", "by source", "boards"), *((r.name, str(r.open_jobs), r.by_source, r.boards) for r in rows)]
    widths = [max(len(c[k]) for c in cells) for k in range(3)]
    lines = ["  ".join([c[0].ljust(widths[0]), c[1].rjust(widths[1]), c[2].ljust(widths[2]), c[3]]).rstrip() for c in cells]
    missing = f", {headline.missing} not registered" if headline.missing else ""
    return "\n".join([*lines, f"{headline.with_jobs} of {headline.companies} companies have open postings ({headline.total_open} in all{missing})"])


def coverage_headline(report: DataFrame, expected: DataFrame) -> DataFrame:
    """Companies with postings, all companies and all postings; expected (name) that the report lacks count as companies."""
    missing = expected.join(report.select(F.lower("name").alias("_key")), F.lower("name") == F.col("_key"), "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    sums = report.agg(F.count_if(F.col("open_jobs") > 0).alias("with_jobs"), F.count(F.lit(1)).alias("listed"), F.coalesce(F.sum("open_jobs"), F.lit(0)).alias("total_open"))
    return sums.crossJoin(missing).select("with_jobs", (F.col("listed") + F.col("missing")).alias("companies"), "missing", "total_open")  # one row each


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """How often each outcome of an upsert occurred."""
    return outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "changed", "unchanged", "mismatch")))


def confusion(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Per label: rows of it, predictions of it, agreements, precision and recall (0 where nothing is there), accuracy of all."""
    cells = rows.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("gold"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("both")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("both")))).alias("c")).select("c.*")
    totals = sides.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("gold", "predicted", "both")))
    overall = cells.agg(F.coalesce(F.sum(F.when(F.col("g") == F.col("p"), F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("accuracy"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return totals.select("label", "gold", "predicted", "both", ratio("both", "predicted").alias("precision"), ratio("both", "gold").alias("recall")).crossJoin(overall)
