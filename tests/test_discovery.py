from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postloom.functions.robots import allows, allows_column
from postloom.operators import discovery
from postloom.sources import feeds

NOW = datetime(2026, 9, 20)


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)])
    return [r[0] for r in df.orderBy("_1").select(f(*(F.col(c) for c in df.columns[1:]))).collect()]


def test_names_of_boards(spark):
    assert values(spark, discovery.slug_variants, "Acme Labs Inc.", "Basalt.io", "Neon", "ሰላም") == [["acmelabsinc", "acme-labs-inc", "acmelabs", "acme-labs"], ["basaltio", "basalt"], ["neon"], []]
    assert values(spark, discovery.is_common_name, "Neon", "Close.com", "Neon Labs", "--") == [True, True, False, False]
    assert values(spark, discovery.names_match, ("Acme", "Acme Inc"), ("Basalt", "Basalt.io"), ("Lantern.dev", "Lantern"), ("--", "--")) == [True, True, False, False]
    assert values(spark, discovery.shares_word, ("Blue Heron", "BlueHeron"), ("Larch", "Larch Foods, Inc"), ("Acme Inc", "Other Inc")) == [True, True, False]
    assert values(spark, discovery.opening_key, "Data Engineer (Remote)", "SRE [EU] - Remote", "Growth Lead Worldwide") == ["data engineer", "sre", "growth lead"]


def test_verdicts(spark):
    boards = spark.createDataFrame([("a", "Acme", None), ("b", "Neon", None), ("c", "Zeta", "zeta.dev"), ("d", "Empty", None), ("e", "Beta", None), ("f", "Gamma", None), ("g", "Acme", None)], "board_id string, name string, domain string")
    text = {"a": "At Acme we build", "b": "Neon is great", "c": "Write to jobs@zeta.dev.", "e": "Beta, inc.", "f": "Other firm", "g": "acme people"}
    jobs = [(b, i, t, text[b]) for b in text for i, t in enumerate(("Software Engineer", f"Special {b}"))]
    jobs = spark.createDataFrame(jobs, "board_id string, ord int, title string, text string")
    known = spark.createDataFrame([("Acme", "Special A (Remote)"), ("Beta", "Software Engineer")], "name string, title string")
    out = discovery.board_verdicts(boards, jobs, known)
    assert {r.board_id: r.verdict for r in out.collect()} == {"a": "owned", "b": "foreign", "c": "proven", "d": "empty", "e": "uncorroborated", "f": "foreign", "g": "foreign"}
    chosen = {r.name: (r.boards, r.ambiguous) for r in discovery.choose(out).collect()}
    assert chosen == {"Acme": (["a"], False), "Zeta": (["c"], False)}


def test_robots(spark):
    text = "﻿User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private # no\nAllow: /private/open\nDisallow: /*.pdf$\nDisallow:\n"
    for path, want in (("/", True), ("/private/x", False), ("/private/open/1", True), ("/a.pdf", False), ("/a.pdf?x", True), ("/%70rivate", False)):
        assert allows(text, path, "us") is want
    assert allows("User-agent: us\nAllow: /\nUser-agent: *\nDisallow: /", "/x", "us") and not allows("User-agent: remote\nAllow: /\nUser-agent: *\nDisallow: /", "/x", "us")
    assert allows("User-agent: *\nAllow: /a\nDisallow: /a", "/a", "us")
    assert allows(None, "/", "us", 404) and allows("", "/", "us", 503) is None and not allows("a\x00", "/", "us")
    df = spark.createDataFrame([(text, "/private"), (text, None)], "t string, p string")
    assert [r[0] for r in df.select(allows_column(F.col("t"), F.col("p"), "us")).collect()] == [False, True]


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>x</title>
<item><title> Dev &amp; Ops </title><link>https://x.example/1</link><guid isPermaLink="false">g1</guid><pubDate>Mon, 14 Sep 2026 10:00:00 +0000</pubDate><description>short</description><content:encoded><![CDATA[<p>Long</p><p>text</p>]]></content:encoded></item>
<item><title>No date</title><link>ftp://x</link></item>
<item><title>Old</title><link>https://x.example/2</link><pubDate>Mon, 5 Jan 2026 10:00:00 +0000</pubDate></item>
<item><title>Odd</title><pubDate>soon</pubDate></item></channel></rss>"""


def test_rss(spark):
    df = spark.createDataFrame([(RSS,)], "body string")
    a, b = feeds.rss(df, NOW).orderBy("ord").collect()
    assert (a.external_id, a.title, a.url, a.description, a.published_at) == ("g1", "Dev & Ops", "https://x.example/1", "Long\n\ntext", datetime(2026, 9, 14, 10))
    assert (b.external_id, b.title, b.published_at) == ("", "No date", None)
    with pytest.raises(Exception, match="no RSS"):
        feeds.rss(spark.createDataFrame([("<html></html>",)], "body string"), NOW).collect()


def test_weworkremotely(spark):
    item = "<item><title>{}</title><region>Anywhere</region><country>🇺🇸 USA</country><type>Full-Time</type><description>d</description><pubDate>Mon, 14 Sep 2026 10:00:00 +0000</pubDate><link>https://weworkremotely.com/remote-jobs/{}</link></item>"
    body = f"<rss><channel>{item.format('Firm: Lead: Dev', 'a-b')}{item.format('Untitled', 'c')}</channel></rss>"
    a, b = feeds.weworkremotely(spark.createDataFrame([(body,)], "body string"), NOW).orderBy("ord").collect()
    assert (a.employer, a.title, a.external_id, a.location_raw, a.verdict, b.verdict) == ("Firm", "Lead: Dev", "a-b", "USA", "kept", "invalid")


def test_ethiojobs(spark):
    import json

    job = {"title": "T", "slug": "k27Tuq-manager", "description": "<b>x</b>", "date_published": "2026-09-15", "date_expiry": "2026-10-01", "city": "Bole", "state": "Addis Ababa", "company": {"name": "Firm"}}
    data = [job, job | {"date_expiry": "2026-09-01"}, job | {"date_published": "2026-01-01"}, job | {"slug": "a/b"}, job | {"company": {"name": "Confidential"}}]
    body = json.dumps({"props": {"pageProps": {"jobs": {"data": data, "meta": {"lastPage": 1}}}}})
    a, b = feeds.ethiojobs(spark.createDataFrame([(body,)], "body string"), NOW).orderBy("ord").collect()
    assert (a.external_id, a.location_raw, a.closed, b.closed, b.title) == ("k27Tuq", "Bole, Addis Ababa", False, True, "")
    with pytest.raises(Exception, match="no list"):
        feeds.ethiojobs(spark.createDataFrame([("{}",)], "body string"), NOW).collect()


def test_boards_in_search_results(spark):
    urls = [
        ("A", 3, "https://jobs.lever.co/acme/1"), ("A", 1, "https://acme.example/jobs"), ("A", 2, "HTTPS://Job-Boards.greenhouse.io/acme-inc?gh=1"), ("B", 1, "https://boards.greenhouse.io/embed/job_board?for=b"),
        ("C", 1, "https://jobs.lever.co/bad.slug"), ("C", 2, "https://www.jobs.lever.co/c"), ("D", 1, "https://jobs.ashbyhq.com/d-d"), ("E", 1, None),
    ]
    out = discovery.boards_found(spark.createDataFrame(urls, "company_name string, rank int, url string")).collect()
    assert {(r.company_name, r.ats_provider, r.external_board_id, r.problem) for r in out} == {("A", "greenhouse", "acme-inc", None), ("B", None, None, "no board found"), ("C", None, None, "no board found"), ("D", "ashby", "d-d", None), ("E", None, None, "no board found")}
    (query,) = values(spark, discovery.board_query, 'Ac"me\nLabs')
    assert query.startswith('"Acme Labs" (site:boards.greenhouse.io OR ') and query.endswith("site:jobs.ashbyhq.com)")


def test_candidates_are_checked(spark):
    rows = [("A", "lever", "a", "https://x/a", False), ("B", "lever", "b", "https://x/b", False), ("C", "lever", "c", "https://x/c", True), ("D", "lever", "d", "https://x/d", False), (" ", "lever", "e", "https://x/e", True), ("F", "lever", "f", "ftp://x/f", True), ("G", "lever", None, "https://x/g", None), ("H", "lever", "h", "https:///h", True)]
    candidates = spark.createDataFrame(rows, "company_name string, ats_provider string, external_board_id string, board_url string, verified boolean")
    probes = spark.createDataFrame([("https://x/a", "HEAD", 200), ("https://x/a", "GET", 500), ("https://x/b", "HEAD", 405), ("https://x/b", "GET", 204), ("https://x/d", "HEAD", 404), ("https://x/d", "GET", 404)], "board_url string, method string, status int").withColumn("at", F.lit(NOW))
    good, bad = discovery.checked_candidates(candidates, probes)
    assert {r.company_name: (r.discovery_metadata["validation_method"], r.discovery_metadata["status_code"]) for r in good.collect()} == {"A": ("HEAD", "200"), "B": ("GET", "204"), "C": ("verified-by-api", "0")}
    assert {r.company_name: r.problem for r in bad.collect()} == {"D": "the board's page answered 404", " ": "company_name is missing", "F": "board_url is not http", "G": "external_board_id is missing", "H": "board_url has no host"}


def test_names_and_domains_in_texts(spark):
    assert values(spark, discovery.mentions, ("We ramp up", "Ramp"), ("At Ramp, we", "Ramp"), ("use gitLAB", "GitLab"), ("an ibm shop", "IBM"), ("Trampoline", "Ramp"), ("Blue  Heron-Labs", "Heron Labs"), ("x", "--")) == [False, True, True, True, False, True, False]
    assert values(spark, discovery.has_domain, ("visit Ramp.com/jobs", "ramp.com"), ("tramp.com", "ramp.com"), ("ramp.company or (ramp.com)", "ramp.com"), ("jobs@ramp.com.", "ramp.com"), ("x", ""), ("a.b", "a.b")) == [True, False, True, True, False, True]


def test_boards_to_retire(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "board_id string")
    registered = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("D", "d")], "name string, board_id string")
    out = discovery.boards_to_retire(registered, ids("b"), ids("a", "b", "c"), spark.createDataFrame([("C",)], "name string"))
    assert [r.board_id for r in out.collect()] == ["a"]
