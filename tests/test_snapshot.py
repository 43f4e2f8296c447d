from datetime import datetime

import pytest

from postloom import schema
from postloom.operators import ingest, snapshot
from postloom.operators.listing import parse_filter

T0, T1, T2 = datetime(2026, 1, 1), datetime(2026, 2, 1), datetime(2026, 3, 1)
POSTING = "company_id bigint, target_company_id bigint, source string, source_job_id string, canonical_url string, title string, description string, application_url string, location_raw string, published_at timestamp, expires_at timestamp, remote_type string, employment_type string, ord bigint"


def batch(spark, *rows):
    return spark.createDataFrame([(1, 10, "s", i, "", t, "d", f"u{i}", place, at, None, remote, "", n) for n, (i, t, place, at, remote) in enumerate(rows)], POSTING)


def empty(spark):
    return spark.createDataFrame([], schema.JOBS)


def by_id(df):
    return {r.source_job_id: r for r in df.collect()}


def test_upsert_is_idempotent_and_keeps_what_is_not_said(spark):
    b = batch(spark, ("1", "A", "X", T0, "remote"), ("2", "B", "", None, ""), ("2", "B2", "", None, ""), ("", "no id", "", None, ""), ("4", " ", "", None, ""))
    first = snapshot.upsert_jobs(empty(spark), b, T0)
    assert {(r.source_job_id, r.outcome) for r in first.outcomes.collect()} == {("1", "inserted"), ("2", "inserted")}
    assert {tuple(r.broken) for r in first.rejects.collect()} == {("source_job_id",), ("title",)}
    stored = spark.createDataFrame(first.rows.collect(), schema.JOBS)
    rows = by_id(stored)
    assert rows["2"].title == "B2" and rows["2"].remote_type == "unknown" and rows["2"].location_raw is None and {r.id for r in rows.values()} == {1, 2}
    again = snapshot.upsert_jobs(stored, b, T1)
    assert {r.outcome for r in again.outcomes.collect()} == {"unchanged"}
    assert all(r.last_seen_at == T1 and r.last_changed_at == T0 for r in again.rows.collect())
    quiet = by_id(snapshot.upsert_jobs(stored, batch(spark, ("1", "A", "X", None, "")), T1).rows)
    assert quiet["1"].published_at == T0 and quiet["1"].remote_type == "remote"


def test_reopened_counts_as_changed(spark):
    b = batch(spark, ("1", "A", "X", T0, ""))
    stored = spark.createDataFrame(snapshot.upsert_jobs(empty(spark), b, T0).rows.collect(), schema.JOBS)
    gone = spark.createDataFrame(snapshot.mark_missing(stored, b.limit(0), [10], T1).collect(), schema.JOBS)
    assert by_id(gone)["1"].status == "removed" and by_id(gone)["1"].closed_at == T1
    back = snapshot.upsert_jobs(gone, b, T2)
    assert back.outcomes.first().outcome == "changed"
    r = by_id(back.rows)["1"]
    assert (r.status, r.closed_at, r.last_changed_at, r.first_seen_at) == ("open", None, T2, T0)
    with pytest.raises(ValueError):
        snapshot.mark_missing(stored, b, [10], T1, fetched=False)
    with pytest.raises(ValueError):
        snapshot.close_stale(stored, 0, T1)


def test_owner_guard_and_move(spark):
    stored = spark.createDataFrame(snapshot.upsert_jobs(empty(spark), batch(spark, ("1", "A", "X", T0, "")), T0).rows.collect(), schema.JOBS)
    other = batch(spark, ("1", "Z", "X", T0, "")).selectExpr("2L AS company_id", "20L AS target_company_id", *[c for c in POSTING.split(", ")[2:] for c in [c.split()[0]]])
    assert snapshot.upsert_jobs(stored, other, T1).outcomes.first().outcome == "mismatch"
    moved = ingest.ingest(stored, other.selectExpr("source", "ord", "source_job_id AS external_id", "title", "application_url AS url", "location_raw", "description", "published_at", "expires_at", "remote_type", "employment_type", "'E' AS employer", "false AS closed", "company_id", "target_company_id"), [20], T1, movable=True)
    r = by_id(moved.rows)["1"]
    assert (r.company_id, r.title, r.status) == (2, "Z", "open")


def test_ingest_full_and_sample(spark):
    cols = "source string, ord bigint, external_id string, title string, url string, location_raw string, description string, published_at timestamp, expires_at timestamp, remote_type string, employment_type string, employer string, closed boolean, company_id bigint, target_company_id bigint"
    job = lambda i, title="T", closed=False, at=T0: ("s", int(i or 0), i, title, f"u{i}", "", "", at, None, "", "", "E", closed, 1, 10)
    listed = spark.createDataFrame([job("1", "x" * 400, at=datetime(2030, 1, 1)), job("2"), job("3", ""), job("4", closed=True), job("")], cols)
    stored = spark.createDataFrame(snapshot.upsert_jobs(empty(spark), batch(spark, *((i, "T", "", T0, "") for i in "2345")), T0).rows.collect(), schema.JOBS)
    out = ingest.ingest(stored, listed, [10], T1)
    rows = by_id(out.rows)
    assert len(rows["1"].title) == 300 and rows["1"].published_at is None
    assert {i: r.status for i, r in rows.items()} == {"1": "open", "2": "open", "3": "open", "4": "closed", "5": "removed"}  # 3 was seen, though unusable
    assert out.skipped.count() == 2
    sample = ingest.ingest(stored, listed, [10], T1, stale_seconds=20 * 86400)
    assert {i: r.status for i, r in by_id(sample.rows).items()} == {"1": "open", "2": "open", "3": "closed", "4": "closed", "5": "closed"}


def test_companies_and_targets(spark):
    none = spark.createDataFrame([], schema.COMPANIES)
    b = spark.createDataFrame([(" Acme ", None, "d", 1), ("ACME", "https://a", None, 2), ("", "x", "x", 3)], "name string, website string, description string, ord bigint")
    rows = snapshot.upsert_companies(none, b, T0).collect()
    assert [(r.id, r.name, r.website, r.description, r.status) for r in rows] == [(1, "Acme", "https://a", "d", "active")]
    stored = spark.createDataFrame(rows, schema.COMPANIES)
    later = snapshot.upsert_companies(stored, b.selectExpr("name", "'other' AS website", "description", "ord"), T1).first()
    assert later.website == "https://a" and later.updated_at == T0
    t = "company_id bigint, ats_provider string, external_board_id string, board_url string, discovery_metadata map<string,string>, market string, ord bigint"
    none = spark.createDataFrame([], schema.TARGETS)
    rows, _ = snapshot.upsert_targets(none, spark.createDataFrame([(1, "lever", " B ", "u", {"a": "1"}, "", 0)], t), T0)
    stored = spark.createDataFrame(rows.collect(), schema.TARGETS)
    assert (stored.first().market, stored.first().is_active, stored.first().external_board_id) == ("worldwide", True, "B")
    for given, want in ((None, {"a": "1"}), ({}, {}), ({"b": "2"}, {"b": "2"})):
        rows, wrong = snapshot.upsert_targets(stored, spark.createDataFrame([(1, "lever", "b", None, given, "ethiopia", 0), (2, "lever", "b", None, None, "", -1)], t), T1)
        assert (rows.first().discovery_metadata, rows.first().board_url, rows.first().market, rows.count(), wrong.count()) == (want, "u", "ethiopia", 1, 0)
    rows, wrong = snapshot.upsert_targets(stored, spark.createDataFrame([(2, "lever", "b", "x", None, "", 0)], t), T1)
    assert rows.first().board_url == "u" and wrong.first().owner_id == 1
    changed, missing = snapshot.set_column(stored, spark.createDataFrame([(1, False), (9, True)], "id bigint, value boolean"), "is_active", T1)
    assert not changed.first().is_active and [r.id for r in missing.collect()] == [9]


def test_expectations(spark):
    stored = snapshot.upsert_jobs(empty(spark), batch(spark, ("1", "A", "X", T0, "")), T0).rows
    good, bad = schema.split_by(stored.unionByName(stored.selectExpr(*["'weird' AS status" if c == "status" else c for c in stored.columns])), schema.job_expectations())
    assert good.count() == 1 and bad.first().broken[0] == "status"


def test_runs_and_gate(spark):
    from datetime import timedelta

    log = snapshot.record_runs(spark.createDataFrame([("a", T0)], schema.RUNS), spark.createDataFrame([(" a ", T1), ("", T1)], schema.RUNS))
    assert [(r.name, r.last_run_at) for r in log.collect()] == [("a", T1)]
    assert not ingest.is_due(log, "a", T1 + timedelta(hours=1), timedelta(hours=6))
    assert ingest.is_due(log, "a", T1 + timedelta(hours=5, minutes=50), timedelta(hours=6)) and ingest.is_due(log, "b", T1, timedelta(hours=6))


def test_parse_filter():
    f = parse_filter({"q": " x ", "priority": "true", "eligibility": "eligible, unclassified,eligible", "page": "3", "page_size": "100", "relevant": "false"})
    assert (f.query, f.priority_only, f.eligibility, f.page, f.page_size, f.relevant_only) == ("x", True, ["eligible", "unclassified"], 3, 100, False)
    for bad in ({"page": "0"}, {"page_size": "101"}, {"remote_type": "x"}, {"priority": "1"}, {"eligibility": "eligible,"}, {"role_family": "A"}, {"page": "x"}):
        with pytest.raises(ValueError):
            parse_filter(bad)
