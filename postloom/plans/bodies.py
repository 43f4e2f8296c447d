"""Queries of the sources: answers in the shapes that sources send, made from the customers, and what they are read as."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import html
from postloom.plans.relations import table
from postloom.session import ship
from postloom.sources import boards, careers, feeds

NOW = datetime(2026, 9, 20)
#: Postings of one answer.
LISTED = 40

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name")


def answers(rows: DataFrame, record: str, listed: str | None) -> DataFrame:
    """One body for LISTED rows: record is an SQL struct of a posting."""
    found = rows.selectExpr(f"id % {LISTED} AS part", f"struct(id AS place, {record} AS r) AS p").groupBy("part").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    whole = F.col("ps.r") if listed is None else F.struct(F.col("ps.r").alias(listed))
    return found.select(F.to_json(whole).alias("body"))


BASE = "WITH c AS (SELECT c_custkey AS id, c_name AS name FROM customer)"


@query("greenhouse_rows", f"""{BASE}
SELECT CASE WHEN id = 0 THEN '' ELSE CAST(id AS VARCHAR) END AS external_id, 'Clerk ' || id AS title, 'https://boards.greenhouse.io/x/' || id AS url, CASE id % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid - Oslo' WHEN 2 THEN 'Non-remote' ELSE 'Oslo' END AS location_raw,
    CASE id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' ELSE '' END AS remote_type, 'At ' || name || chr(10) || chr(10) || 'now' AS description, CASE WHEN id % 5 <> 0 THEN TIMESTAMP '2026-09-01 08:00:00' END AS published_at FROM c""")
def _(spark, d):
    place = "CASE id % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid - Oslo' WHEN 2 THEN 'Non-remote' ELSE 'Oslo' END"
    record = f"""named_struct('id', id, 'title', concat('  Clerk ', id, ' '), 'absolute_url', concat('https://boards.greenhouse.io/x/', id), 'location', named_struct('name', {place}),
        'content', concat('&lt;p&gt;At ', name, '&lt;/p&gt;&lt;p&gt;now&lt;/p&gt;'), 'first_published', CASE WHEN id % 5 <> 0 THEN '2026-09-01T10:00:00+02:00' ELSE 'soon' END)"""
    return boards.greenhouse(answers(customers(spark, d), record, "jobs")).select("external_id", "title", "url", "location_raw", "remote_type", "description", "published_at")


@query("lever_rows", f"""{BASE}
SELECT CAST(id AS VARCHAR) AS external_id, CASE WHEN id % 3 = 0 THEN '' ELSE 'https://jobs.lever.co/x/' || id END AS url, CASE WHEN id % 2 = 0 THEN 'Oslo; Rome' ELSE 'Oslo' END AS location_raw,
    CASE id % 3 WHEN 0 THEN 'onsite' WHEN 1 THEN 'remote' ELSE '' END AS remote_type, CASE id % 4 WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' WHEN 2 THEN 'contract' ELSE '' END AS employment_type,
    'Intro' || chr(10) || chr(10) || 'Duties' || chr(10) || 'one' || chr(10) || 'two' AS description, TIMESTAMP '2026-01-01 00:00:00' + to_seconds(id) AS published_at FROM c""")
def _(spark, d):
    record = """named_struct('id', concat(' ', id), 'text', name, 'hostedUrl', CASE WHEN id % 3 = 0 THEN 'http://jobs.lever.co/x' ELSE concat('https://jobs.lever.co/x/', id) END, 'createdAt', 1767225600000 + id * 1000,
        'workplaceType', CASE id % 3 WHEN 0 THEN 'on-site' WHEN 1 THEN 'REMOTE' ELSE 'unspecified' END, 'categories', named_struct('commitment', CASE id % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part Time' WHEN 2 THEN 'Freelance' ELSE 'Other' END,
        'location', 'Oslo', 'allLocations', CASE WHEN id % 2 = 0 THEN array('Oslo', 'Rome') ELSE array('Oslo') END), 'descriptionPlain', 'Intro', 'lists', array(named_struct('text', 'Duties', 'content', '<li>one</li><li>two</li>')))"""
    return boards.lever(answers(customers(spark, d), record, None)).select("external_id", "url", "location_raw", "remote_type", "employment_type", "description", "published_at")


@query("ashby_rows", f"""{BASE}
SELECT 'a' || id AS external_id, name AS title, 'Oslo; Rome' AS location_raw, CASE WHEN id % 2 = 0 THEN 'remote' ELSE 'hybrid' END AS remote_type, CASE id % 5 WHEN 0 THEN 'x' ELSE 'plain ' || id END AS description FROM c WHERE id % 7 <> 0""")
def _(spark, d):
    record = """named_struct('id', concat('a', id), 'title', name, 'location', 'Oslo', 'secondaryLocations', array(named_struct('location', ' Rome '), named_struct('location', ' ')), 'isListed', CASE WHEN id % 7 = 0 THEN false WHEN id % 3 = 0 THEN true END,
        'isRemote', true, 'workplaceType', CASE WHEN id % 2 = 0 THEN '' ELSE 'Hybrid' END, 'jobUrl', 'https://jobs.ashbyhq.com/x', 'descriptionPlain', CASE WHEN id % 5 <> 0 THEN concat('plain ', id) END, 'descriptionHtml', '<p>x</p>')"""
    return boards.ashby(answers(customers(spark, d), record, "jobs")).select("external_id", "title", "location_raw", "remote_type", "description")


@query("remotive_rows", f"""{BASE}, r AS (
    SELECT *, id % 5 = 0 OR id % 11 = 0 AS bad, id % 6 = 0 OR id % 4 = 0 AS out_ FROM c
)
SELECT CAST(id AS VARCHAR) AS external_id, CASE WHEN bad THEN 'invalid' WHEN out_ THEN 'dropped' ELSE 'kept' END AS verdict, CASE id % 3 WHEN 0 THEN 'full_time' WHEN 1 THEN 'contract' ELSE '' END AS employment_type,
    CASE WHEN id % 11 = 0 THEN NULL WHEN id % 4 = 0 THEN TIMESTAMP '2026-08-01 00:00:00' ELSE TIMESTAMP '2026-09-10 12:00:00' END AS published_at FROM r""")
def _(spark, d):
    record = """named_struct('id', id, 'url', CASE WHEN id % 5 = 0 THEN 'https://remotive.example/1' ELSE concat('https://remotive.com/j/', id) END, 'title', name, 'company_name', CASE WHEN id % 6 = 0 THEN 'Confidential' ELSE name END,
        'job_type', CASE id % 3 WHEN 0 THEN 'full_time' WHEN 1 THEN 'freelance' ELSE 'odd' END, 'publication_date', CASE WHEN id % 11 = 0 THEN 'soon' WHEN id % 4 = 0 THEN '2026-08-01T00:00:00' ELSE '2026-09-10T12:00:00' END)"""
    return boards.remotive(answers(customers(spark, d), record, "jobs"), NOW).select("external_id", "verdict", "employment_type", "published_at")


@query("himalayas_rows", f"""{BASE}
SELECT 'https://himalayas.app/x/' || id AS external_id, CASE WHEN id % 2 = 0 THEN 'Kenya, Uganda' WHEN id % 3 = 0 THEN '' ELSE 'Kenya' END AS location_raw, CASE WHEN id % 7 = 0 THEN 'dropped' ELSE 'kept' END AS verdict,
    CASE WHEN id % 5 = 0 THEN 'short' ELSE 'long' END AS description, TIMESTAMP '2026-09-15 00:00:00' AS published_at FROM c""")
def _(spark, d):
    seconds = int(datetime(2026, 9, 15).timestamp() - datetime(1970, 1, 1).timestamp())
    record = f"""named_struct('title', name, 'companyName', concat(name, '  Ltd'), 'employmentType', 'Full Time', 'locationRestrictions', CASE WHEN id % 2 = 0 THEN array('Kenya', 'Uganda') WHEN id % 3 = 0 THEN array() ELSE array('Kenya') END,
        'pubDate', {seconds}, 'expiryDate', CASE WHEN id % 7 = 0 THEN {seconds} ELSE {seconds} + 864000 END, 'applicationLink', concat('https://himalayas.app/x/', id), 'guid', concat('https://himalayas.app/x/', id),
        'description', CASE WHEN id % 5 = 0 THEN '' ELSE '<b>long</b>' END, 'excerpt', 'short')"""
    return boards.himalayas(answers(customers(spark, d), record, "jobs"), NOW).select("external_id", "location_raw", "verdict", "description", "published_at")


@query("weworkremotely_rows", f"""{BASE}
SELECT CASE WHEN id % 4 = 0 THEN '' ELSE 'x-' || id END AS external_id, CASE WHEN id % 3 = 0 THEN '' ELSE 'Lead: Baker' END AS title, CASE WHEN id % 3 = 0 THEN '' ELSE name END AS employer, CASE WHEN id % 2 = 0 THEN 'Kenya' ELSE 'Anywhere' END AS location_raw,
    CASE WHEN id % 3 = 0 OR id % 4 = 0 THEN 'invalid' ELSE 'kept' END AS verdict FROM c""")
def _(spark, d):
    item = F.expr("""concat('<item><title>', CASE WHEN id % 3 = 0 THEN 'No employer' ELSE concat(name, ': Lead: Baker') END, '</title><region>Anywhere</region><country>', CASE WHEN id % 2 = 0 THEN '🇰🇪 Kenya' ELSE '' END,
        '</country><type>Full-Time</type><description>d</description><pubDate>Mon, 14 Sep 2026 10:00:00 +0000</pubDate><link>https://weworkremotely.com/', CASE WHEN id % 4 = 0 THEN 'blog/' ELSE 'remote-jobs/x-' END, id, '</link></item>')""")
    bodies = customers(spark, d).groupBy((F.col("id") % LISTED).alias("part")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    return feeds.weworkremotely(bodies, NOW).select("external_id", "title", "employer", "location_raw", "verdict")


@query("careers_rows", f"""{BASE}
SELECT 'mill.example/jobs/' || id % {LISTED} || '/opening-' || id AS external_id, CASE id % 5 WHEN 0 THEN 'Opening ' || id WHEN 1 THEN 'Heading ' || id WHEN 2 THEN 'Page ' || id ELSE 'Baker ' || id END AS title,
    CASE WHEN id % 5 IN (0, 4) THEN '' ELSE 'Text of ' || name END AS description FROM c WHERE id % 6 <> 0""")
def _(spark, d):
    c = customers(spark, d).withColumn("listing", F.expr(f"concat('https://www.mill.example/jobs/', id % {LISTED})"))
    link = F.expr("concat('<a href=\"', listing, '/opening-', id, '?utm_source=x\">', CASE WHEN id % 5 IN (0, 1, 2) THEN 'Read more' ELSE concat('Baker ', id, ' → Oslo') END, '</a><a href=\"/about\">About</a>')")
    listings = c.groupBy(F.col("listing").alias("url")).agg(F.array_join(F.collect_list(link), "\n").alias("html"))
    page = F.expr("concat(CASE id % 5 WHEN 1 THEN concat('<h1>Heading ', id, '</h1>') WHEN 2 THEN concat('<title>Page ', id, ' | Mill</title>') ELSE '' END, '<main><p>Text of ', name, '</p></main>')")
    status = F.expr("CASE WHEN id % 6 = 0 THEN 404 WHEN id % 5 IN (0, 4) THEN 503 ELSE 200 END")
    details = c.select(F.expr("concat(listing, '/opening-', id)").alias("url"), status.alias("status"), F.when(status == 200, page).alias("html"))
    return careers.careers_site(listings, details, NOW, most=1_000_000).rows.select("external_id", "title", "description")


@query("html_texts", f"""{BASE}
SELECT id, CASE id % 5 WHEN 0 THEN name || chr(10) || chr(10) || 'two' WHEN 1 THEN 'a' || chr(10) || 'b' || chr(10) || 'c' || id || chr(10) || 'd' WHEN 2 THEN 'esc ' || id WHEN 3 THEN 'x y & ' || id ELSE 'l r' || id END AS text,
    CASE id % 2 WHEN 0 THEN 'In ' || name ELSE 'All' END AS main FROM c""")
def _(spark, d):
    ship(spark)
    shape = F.expr("CASE id % 5 WHEN 0 THEN concat('<p>', name, '</p>\n<p> two </p>') WHEN 1 THEN concat('a<br>b<ul><li>c', id, '</li><li>d</li></ul>') WHEN 2 THEN concat('&lt;p&gt;esc ', id, '&lt;/p&gt;') WHEN 3 THEN concat('x<script>bad()</script> y &amp; ', id) ELSE concat('<table><tr><td>l</td><td>r', id, '</td></tr></table>') END")
    page = F.expr("CASE id % 2 WHEN 0 THEN concat('<nav>Menu</nav><main><p>In ', name, '</p><footer>Foot</footer></main><p>Out</p>') ELSE '<html><body><aside>No</aside><p>All</p></body></html>' END")
    return customers(spark, d).select("id", html.html_to_text_column(shape).alias("text"), html.main_text_column(page).alias("main"))


@query("html_pages", f"""{BASE}
SELECT id, 'T ' || id AS title, 'H ' || name AS h1, 'https://s.example/jobs/' || id || '?a=1' AS link, 'Go ' || id AS anchor, 'Posting ' || id AS posting, CASE WHEN id % 2 = 0 THEN 'Oslo, NO; Rome' ELSE 'Oslo, NO' END AS location FROM c""")
def _(spark, d):
    ship(spark)
    place = "{\"address\": {\"addressLocality\": \"Oslo\", \"addressCountry\": {\"name\": \"NO\"}}}"
    source = F.expr(f"""concat('<title> T ', id, '</title><title>Second</title><h1>H <b>', name, '</b></h1><a href="', id, '?a=1">Go <i>', id, '</i></a><a>none</a><script type="application/ld+json">{{"@graph": [{{"@type": "Other"}}, {{"@type": ["JobPosting"], "title": "Posting ',
        id, '", "jobLocation": ', CASE WHEN id % 2 = 0 THEN '[{place}, {{"address": "Rome"}}]' ELSE '{place}' END, '}}]}}</script><script type="application/ld+json">broken</script>')""")
    p = customers(spark, d).select("id", html.page_column(F.lit("https://s.example/jobs/"), source).alias("p"))
    return p.select("id", "p.title", "p.h1", F.col("p.links")[0]["url"].alias("link"), F.col("p.links")[0]["text"].alias("anchor"), F.col("p.postings")[0]["title"].alias("posting"), F.col("p.postings")[0]["location"].alias("location"))


@query("text_sentences", f"""{BASE}
SELECT id, CASE id % 3 WHEN 0 THEN 'You must live in the US today|Yes' WHEN 1 THEN 'Pay eg ' || id || ' birr|One of two three|four' ELSE 'a ' || id || '|b|c.' END AS sentences FROM c""")
def _(spark, d):
    ship(spark)
    shape = F.expr("CASE id % 3 WHEN 0 THEN '<p>You must live in</p><p>the U.S. today. Yes</p>' WHEN 1 THEN concat('Pay e.g. ', id, ' birr; One of\ntwo three\nfour') ELSE concat('<div>a&nbsp; ', id, '!  b</div><br/>c.') END")
    return customers(spark, d).select("id", F.array_join(html.sentences_column(html.plain_text_column(shape)), "|").alias("sentences"))
