import json
from datetime import datetime, timedelta

import pytest

from postloom import schema
from postloom.operators import register
from postloom.sources import config, search

NOW = datetime(2026, 9, 20)
AGE = timedelta(days=90)


def found(spark, results, **more):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(results)], "ord bigint, url string, title string, snippet string, date string")
    return search.results(df, NOW, AGE, **more).orderBy("ord").collect()


def test_company_search(spark):
    view = "https://et.linkedin.com/jobs/view/"
    out = found(spark, [
        (view + "ui-ux-designer-at-scale-at-chapa-4465000000?x=1", "Chapa hiring UI/UX Designer at scale in Addis Ababa, Ethiopia | LinkedIn", "x", "3 days ago"),
        (view + "dev-at-other-4465000000", "t", "s", None), ("https://x.example/", "t", "s", None), (view + "dev-at-chapa-4465000001", "t", "No longer accepting applications", None),
        (view + "dev-at-chapa-4465000002", "t", "s", "8 months ago"), (view.replace("et.", "www.") + "dev-at-chapa-4465000003", "t", "Posted in Noida", None),
    ], accepted=["chapa"], employer="Chapa")
    assert [r.reason for r in out] == [None, "other-company", "not-a-job-url", None, None, "outside-ethiopia"]
    assert [r.closed for r in out] == [False, False, False, True, True, False]
    assert (out[0].title, out[0].employer, out[0].location_raw, out[0].external_id) == ("UI/UX Designer at scale", "Chapa", "Addis Ababa, Ethiopia", "linkedin:4465000000")
    assert search.reasons(spark.createDataFrame([(r.reason,) for r in out], 'reason string')).count() == 3


def test_keyword_search(spark):
    view = "https://et.linkedin.com/jobs/view/"
    out = found(spark, [
        (view + "engineer-at-look-at-me-inc-4465000000", "Look At Me, Inc hiring Engineer in Addis Ababa | x", "", None), (view + "go-dev-at-kifiya-tech-4465000000", "Go Dev | at KIFIYA Tech", "", None),
        (view + "clerk-at-confidential-4465000000", "", "", None), (view + "clerk-at-new-firm-4465000000", "", "", None), (view + "clerk-4465000000", "", "", None),
    ])
    assert [(r.employer, r.title) for r in out[:2]] == [("Look At Me, Inc", "Engineer"), ("KIFIYA Tech", "Go Dev")]
    assert (out[3].employer, out[3].title) == ("New Firm", "Clerk")
    assert [r.reason for r in out] == [None, None, "no-employer", None, "no-employer"]


def test_filters_do_not_repeat_the_work(spark):
    view = "https://et.linkedin.com/jobs/view/"
    rows = [("https://x.example/", "", "", None), (view + "clerk-at-confidential-4465000000", "", "", None), (view.replace("et.", "www.") + "clerk-at-firm-4465000001", "Clerk", "in Noida", None), (view + "clerk-at-firm-4465000002", "Clerk at Firm", "", "8 months ago"), (view + "clerk-at-firm-4465000003", "Clerk at Firm", "", "3 days ago")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows * 4)], "ord bigint, url string, title string, snippet string, date string")
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    for more in ({}, {"accepted": ["firm"], "employer": "Firm"}):
        all_rows = search.results(df, NOW, AGE, **more)
        for cut, kept in (("reason is not null", lambda r: r.reason is not None), ("reason is null and not closed", lambda r: r.reason is None and not r.closed), ("employer = 'Firm'", lambda r: r.employer == "Firm"), ("title <> ''", lambda r: r.title != "")):
            some = all_rows.where(cut)
            assert size(some) < 2 * size(all_rows), cut  # not all expressions in place of the columns
            assert some.orderBy("ord").collect() == [r for r in all_rows.orderBy("ord").collect() if kept(r)]
    assert {tuple(r) for r in search.reasons(search.results(df, NOW, AGE)).collect()} == {("not-a-job-url", 4), ("no-employer", 4), ("outside-ethiopia", 4)}


def test_register(spark):
    none = spark.createDataFrame([], schema.COMPANIES), spark.createDataFrame([], schema.TARGETS)
    cols = "employer string, provider string, priority boolean, market string, ord bigint"
    rows = spark.createDataFrame([(" Acme  Ltd ", "board", False, "", 0), ("ACME Ltd", "board", True, "ethiopia", 1), ("", "board", False, "", 2), ("x" * 201, "board", False, "", 3)], cols)
    companies, targets, refused = register.ensure_targets(*none, rows, NOW)
    assert [(c.name, c.is_priority) for c in companies.collect()] == [("Acme Ltd", True)]
    assert [(t.external_board_id, t.market) for t in targets.collect()] == [("acme ltd", "ethiopia")] and refused.count() == 2
    stored = spark.createDataFrame(companies.collect(), schema.COMPANIES), spark.createDataFrame(targets.collect(), schema.TARGETS)
    again, _, _ = register.ensure_targets(*stored, rows.where("ord = 0"), NOW)
    assert again.first().is_priority


def test_seed_and_config(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"companies": [{"name": "Chapa", "website": "https://chapa.example", "feeds": ["https://chapa.example/rss"], "career_pages": []}, {"name": "Kifiya", "aliases": ["KFT"]}]}))
    entries = config.priority_companies(spark, str(path))
    none = spark.createDataFrame([], schema.COMPANIES), spark.createDataFrame([], schema.TARGETS)
    companies, targets, refused = register.seed_priority(*none, entries, NOW)
    assert {(c.name, c.is_priority, c.website) for c in companies.collect()} == {("Chapa", True, "https://chapa.example"), ("Kifiya", True, None)}
    assert {(t.ats_provider, t.external_board_id, t.market) for t in targets.collect()} == {("search", "Chapa", "ethiopia"), ("feed", "https://chapa.example/rss", "ethiopia"), ("search", "Kifiya", "ethiopia")}
    assert refused.count() == 0
    for bad in ({"companies": []}, {"companies": [{"name": "a"}, {"name": "A"}]}, {"companies": [{"name": "a", "feed": []}]}, {"companies": [{"name": "a", "website": "x"}]}, {"other": 1}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.priority_companies(spark, str(path))
    path.write_text(json.dumps({"keywords": [" Go ", "go", "Rust"], "pages": 2}))
    assert config.keywords(str(path)) == (["Go", "Rust"], 2)
    path.write_text("# x\nAcme | Acme.dev\nacme\n\nBeta\n")
    assert config.names(str(path)) == [("Acme", "acme.dev"), ("Beta", None)]
