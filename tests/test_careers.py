from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postloom.operators import ingest
from postloom.sources import careers, search

NOW = datetime(2026, 9, 20)


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def test_titles_to_fall_back_on(spark):
    assert values(spark, careers.anchor_title, "Baker → Adama · Remote", " View Job ", "x" * 121, "Baker", None) == ["Baker", "", "", "Baker", ""]
    assert values(spark, careers.clean_page_title, "Baker - Night | Mill & Co", "A | B | C", " | Mill", "Miller – Mill — x", None) == ["Baker", "A | B", "| Mill", "Miller", ""]
    assert values(spark, careers.title_from_slug, "https://m.example/jobs/head-baker_2/", "https://m.example/jobs/0123-abcd-ef", "https://m.example", "https://m.example/jobs/élan-vital") == ["Head Baker 2", "", "", "Élan Vital"]
    assert values(spark, careers.looks_like_id, "", "deadbeef", "dead", "baker-12") == [True, True, False, False]


LISTING = """<a href="/jobs/baker?utm_source=x&id=7#top"><img></a><a href="https://www.mill.example/jobs/baker/?id=7">Baker →  Adama</a>
<a href="/jobs/miller">Read more</a><a href="/jobs/gone">Gone</a><a href="/jobs/old">Old</a><a href="/jobs/over">Over</a><a href="/jobs/away">Away team</a><a href="/jobs/culture/us">Us</a>
<a href="/jobs/plan.PDF">Plan</a><a href="/jobs/">All</a><a href="/about">About</a><a href="https://other.example/jobs/x">X</a><a href="mailto:a@mill.example">Mail</a><a href="/jobsite/x">No</a>"""
POSTING = """<script type="application/ld+json">{"@type": "JobPosting", "title": "Head baker", "description": "<p>Bake</p><p>bread</p>", "datePosted": "2026-09-01", "validThrough": "2026-12-01", "jobLocation": {"address": {"addressLocality": "Adama", "addressCountry": "ET"}}}</script>"""


@pytest.fixture(scope="module")
def site(spark):
    listings = [("https://mill.example/jobs", LISTING), ("https://mill.example/", LISTING), ("ftp://mill.example/jobs", LISTING), ("https://none.example/jobs", "<p>Nothing</p>"), ("https://lost.example/jobs", None)]
    listings.append(("https://big.example/jobs", "".join(f'<a href="/jobs/{k}">Opening {k}</a>' for k in range(101))))
    details = [
        ("https://www.mill.example/jobs/baker/?id=7", 200, "<h1>Wrong</h1>"), ("https://mill.example/jobs/baker?id=7", 200, POSTING + "<h1>Other</h1>"),
        ("https://mill.example/jobs/miller", 200, "<title>Miller | Mill</title><main><p>Grind</p></main><nav>x</nav>"), ("https://mill.example/jobs/gone", 404, None),
        ("https://mill.example/jobs/old", 200, '<meta property="article:published_time" content="2026-01-01T10:00:00Z"><h1>Old</h1>'),
        ("https://mill.example/jobs/over", 200, POSTING.replace("2026-12-01", "2026-09-10")), ("https://mill.example/jobs/away", 503, None),
    ]
    return careers.careers_site(spark.createDataFrame(listings, "url string, html string"), spark.createDataFrame(details, "url string, status int, html string"), NOW)


def test_postings_of_a_site(site):
    a, b, c = site.rows.orderBy("ord").collect()
    assert (a.external_id, a.title, a.url, a.location_raw, a.description) == ("mill.example/jobs/baker?id=7", "Head baker", "https://mill.example/jobs/baker?id=7", "Adama, ET", "Bake\n\nbread")
    assert (a.published_at, a.expires_at) == (datetime(2026, 9, 1), datetime(2026, 12, 1))
    assert (b.external_id, b.title, b.description, b.published_at) == ("mill.example/jobs/miller", "Miller", "Grind", None)
    assert (c.external_id, c.title, c.description) == ("mill.example/jobs/away", "Away team", "")  # stays, so that it is not closed


def test_listings_that_say_nothing(site):
    assert {r.listing: r.problem for r in site.problems.collect()} == {
        "https://mill.example/": "invalid", "ftp://mill.example/jobs": "invalid", "https://none.example/jobs": "no links", "https://lost.example/jobs": "not found", "https://big.example/jobs": "too many links",
    }


def test_budgets_and_retries():
    calls = []

    def search_(*answers):
        it = iter(answers)

        def one():
            calls.append(1)
            x = next(it)
            if isinstance(x, Exception):
                raise x
            return x

        return one

    budget = search.Budget(4)
    assert search.metered(budget, search_(OSError(), ["r"])) == ["r"] and budget.used == 2
    with pytest.raises(search.Unauthorized):
        search.metered(budget, search_(search.Unauthorized(), ["r"]))
    with pytest.raises(search.BudgetSpent):
        search.metered(budget, search_(OSError(), ["r"]))
    assert budget.used == 4 and len(calls) == 4
    with pytest.raises(OSError):
        search.metered(search.Budget(9), search_(OSError(), OSError(), ["r"]))


def test_partial_results_and_run_reports(spark):
    df = spark.range(1)
    assert [ingest.Collected("a", df).usable, ingest.Collected("a", df, "cut", True).usable, ingest.Collected("a", df, "cut").usable, ingest.Collected("a", None, "down", True).usable] == [True, True, False, False]
    schema = "name string, error string, inserted int, changed int, unchanged int, skipped int, removed int"
    rows = [("a", None, 3, 1, 0, 2, None), ("b", "cut", 5, 0, 0, 0, 1), ("c", "down", None, None, None, None, None)]
    report = ingest.run_report(spark.createDataFrame(rows, schema)).first().asDict()
    assert report == {"succeeded": 1, "failed": 2, "inserted": 8, "changed": 1, "unchanged": 0, "skipped": 2, "removed": 1, "all_failed": False}
    assert ingest.run_report(spark.createDataFrame(rows[1:], schema)).first().all_failed and not ingest.run_report(spark.createDataFrame([], schema)).first().all_failed


def test_collectors_do_not_store_what_an_earlier_one_has(spark):
    schema = "employer_key string, title string, location_raw string, closed boolean, ord int"
    one = spark.createDataFrame([("mill", "Baker", "Adama", False, 0), ("mill", "Porter", "Adama", True, 1)], schema)
    two = spark.createDataFrame([("mill", "baker", "Adama, Ethiopia", False, 0), ("mill", "Porter", "Adama", False, 1), ("inn", "Baker", "Adama", False, 2)], schema)
    (_, a), (_, b) = ingest.dedupe_across([("one", one), ("two", two)], "ethiopia")
    assert a.count() == 2 and sorted((r.employer_key, r.title) for r in b.collect()) == [("inn", "Baker"), ("mill", "Porter")]


def test_routes(spark):
    out = spark.createDataFrame([(True,), (False,)], "p boolean").select("p", *ingest.route("feed", "worldwide", F.col("p"), "search"), *ingest.route("feed", "worldwide", F.col("p"), "")).collect()
    assert [tuple(r) for r in out] == [(True, "search", "ethiopia", "feed", "worldwide"), (False, "feed", "worldwide", "feed", "worldwide")]
