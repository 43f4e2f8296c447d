"""Rules that have to hold at any size: robots patterns, numbering, moves, written upserts, tables of targets, pages."""

import re
import time
from datetime import datetime

import pytest

from postloom import schema
from postloom.functions import robots
from postloom.operators import ingest, snapshot
from postloom.operators.listing import Filter, JobsRepository

T0, T1, T2 = datetime(2026, 1, 1), datetime(2026, 2, 1), datetime(2026, 3, 1)
POSTING = "company_id bigint, target_company_id bigint, source string, source_job_id string, canonical_url string, title string, description string, application_url string, location_raw string, published_at timestamp, expires_at timestamp, remote_type string, employment_type string, ord bigint"


def postings(spark, n, target=lambda i: 10 + i % 3):
    return spark.createDataFrame([(1, target(i), "s", str(i), "", f"T{i}", "d", f"u{i}", "", None, None, "", "", i) for i in range(n)], POSTING)


def stored(spark, df):
    return spark.createDataFrame(df.collect(), schema.JOBS)


def test_many_stars_take_no_time():
    began = time.perf_counter()
    assert not robots.fits("/" + "*a" * 20 + "$", "/" + "a" * 4000 + "b") and robots.fits("/" + "*a" * 20, "/" + "a" * 4000 + "b")
    assert not robots.fits("*" + "a*" * 20 + "c", "a" * 100_000)
    assert time.perf_counter() - began < 0.1


def test_patterns_match_a_backtracking_search():
    import itertools

    for p in map("".join, itertools.product("ab*$", repeat=4)):
        if "$" in p[:-1]:
            continue
        end = p.endswith("$")
        slow = re.compile("[ab]*?".join(map(re.escape, re.split(r"\*+", p[:-1] if end else p))) + (r"\Z" if end else ""))
        for path in map("".join, itertools.product("ab", repeat=4)):
            assert robots.fits(p, path) == bool(slow.match(path)), (p, path)


def test_numbers_are_gapless_in_any_number_of_parts(spark, monkeypatch):
    monkeypatch.setattr(snapshot, "ROWS_OF_A_PART", 2)
    up = snapshot.upsert_jobs(spark.createDataFrame([], schema.JOBS), postings(spark, 300), T0)
    assert sorted(r.id for r in up.rows.select("id").collect()) == list(range(1, 301))


def test_moves_to_the_same_place_change_nothing(spark):
    old = stored(spark, snapshot.upsert_jobs(spark.createDataFrame([], schema.JOBS), postings(spark, 2), T0).rows)
    moves = spark.createDataFrame([("s", "0", 10, 1), ("s", "1", 77, 1)], "source string, source_job_id string, target_company_id bigint, company_id bigint")
    out = {r.source_job_id: (r.target_company_id, r.updated_at) for r in snapshot.move_jobs(old, moves, T1).collect()}
    assert out == {"0": (10, T0), "1": (77, T1)}


def test_a_written_upsert_is_the_same(spark, tmp_path):
    first = snapshot.upsert_jobs(spark.createDataFrame([], schema.JOBS), postings(spark, 20), T0)
    again = first.written(str(tmp_path / "up"))
    assert sorted(again.rows.collect()) == sorted(first.rows.collect()) and sorted(again.outcomes.collect()) == sorted(first.outcomes.collect())
    assert again.rows._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


@pytest.mark.parametrize("as_table", [False, True])
def test_targets_are_a_list_or_a_table(spark, as_table):
    old = stored(spark, snapshot.upsert_jobs(spark.createDataFrame([], schema.JOBS), postings(spark, 9), T0).rows)
    targets = spark.createDataFrame([(10,), (10,), (11,)], "target_company_id bigint") if as_table else [10, 11]
    seen = spark.createDataFrame([(10, "0")], "target_company_id bigint, source_job_id string")
    gone = {r.source_job_id for r in snapshot.mark_missing(old, seen, targets, T1).collect() if r.status == "removed"}
    assert gone == {"3", "6", "1", "4", "7"}
    stale = {r.source_job_id for r in snapshot.close_stale(old, 86400, T1, targets).collect() if r.status == "closed"}
    assert stale == {"0", "3", "6", "1", "4", "7"}


def test_absent_boards_age_out_and_gone_boards_go(spark):
    old = stored(spark, snapshot.upsert_jobs(spark.createDataFrame([], schema.JOBS), postings(spark, 9), T0).rows)
    targets = spark.createDataFrame([(10, "lever", True), (11, "lever", True), (12, "lever", False)], "id bigint, ats_provider string, is_active boolean")
    touched = spark.createDataFrame([(10,)], "id bigint")
    swept = ingest.sweep_absent(old, targets, touched, "lever", 86400, T1)
    assert {r.source_job_id for r in swept.collect() if r.status == "closed"} == {"1", "4", "7"}
    assert not [r for r in ingest.sweep_absent(old, targets, touched, "lever", 400 * 86400, T1).collect() if r.status != "open"]
    boards = spark.createDataFrame([(10, True, T0), (11, True, T0)], "id bigint, is_active boolean, updated_at timestamp")
    jobs, after = ingest.retire_board(old, boards, 11, T2)
    assert {r.source_job_id for r in jobs.collect() if r.status == "removed"} == {"1", "4", "7"}
    assert {tuple(r) for r in after.collect()} == {(10, True, T0), (11, False, T2)}


def test_pages_carry_verdicts_whether_the_filter_asks_or_not(spark):
    jobs = stored(spark, snapshot.upsert_jobs(spark.createDataFrame([], schema.JOBS), postings(spark, 9), T0).rows)
    companies = spark.createDataFrame([(1, "C", "w", False)], "id bigint, name string, website string, is_priority boolean")
    targets = spark.createDataFrame([(k, "worldwide") for k in (10, 11, 12)], "id bigint, market string")
    verdicts = spark.createDataFrame([(k, "eligible", 0.5, "b", k == 3, "software") for k in range(1, 6)], "job_id bigint, status string, confidence double, basis string, relevant boolean, role_family string")
    verdicts = verdicts.selectExpr("*", "array('r') AS reasons", "CAST(array() AS array<struct<field:string,text:string>>) AS evidence", "CAST(array() AS array<string>) AS restrictions", "'' AS hours_constraint")
    repository = JobsRepository(jobs, companies, targets, verdicts)
    page = repository.list(Filter(page_size=4), T1).collect()
    assert len(page) == 4 and {r.total for r in page} == {9}
    assert all((r.eligibility is not None) == (r.id <= 5) for r in page)
    page = repository.list(Filter(relevant_only=True), T1).collect()
    assert [(r.id, r.total, r.eligibility.status) for r in page] == [(3, 1, "eligible")]
    assert repository.total(Filter(eligibility=["unclassified"]), T1).first().total == 4
    assert repository.get("3", T1).first().relevant and repository.get("x", T1).count() == 0


def test_rows_without_parents_stop_a_run(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id bigint")
    rows = spark.createDataFrame([(1,), (2,), (None,)], "company_id bigint")
    assert schema.require_parents(rows, "company_id", parents).count() == 3
    with pytest.raises(schema.Orphans, match="company_id refers to rows that are not there, such as 9"):
        schema.require_parents(rows.union(spark.createDataFrame([(9,)], "company_id bigint")), "company_id", parents)


def test_reports_as_text(spark):
    from postloom.operators.reports import coverage_text

    rows = spark.createDataFrame([("Old Mill", 12, "feed=12", "feed greenhouse(inactive)"), ("Inn", 0, "-", "none")], "name string, open_jobs int, by_source string, boards string").collect()
    head = spark.createDataFrame([(1, 3, 1, 12)], "with_jobs int, companies int, missing int, total_open int").first()
    assert coverage_text(rows, head).split("\n") == ["company   open  by source  boards", "Old Mill    12  feed=12    feed greenhouse(inactive)", "Inn          0  -          none", "1 of 3 companies have open postings (12 in all, 1 not registered)"]
