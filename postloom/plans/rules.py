"""Queries of expectations, keyed updates, target upserts, search results and board discovery."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postloom import schema
from postloom.operators import discovery, snapshot
from postloom.plans.relations import COMPANIES, JOBS, TARGETS, companies, jobs, targets
from postloom.sources import search

NOW = datetime(1998, 9, 1)
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("expectation_rejects", f"""
WITH {JOBS}, b AS (
    SELECT id, CASE WHEN id % 8 = 0 THEN ' ' ELSE title END AS title, CASE WHEN id % 9 = 0 THEN 'home' ELSE remote_type END AS remote_type, CASE WHEN id % 10 = 0 THEN NULL ELSE closed_at END AS closed_at, status FROM jobs
), x AS (
    SELECT id, id % 8 = 0 AS t, id % 9 = 0 AS r, (status <> 'open') <> (closed_at IS NOT NULL) AS c FROM b
)
SELECT id, concat_ws(',', CASE WHEN t THEN 'title' END, CASE WHEN r THEN 'remote_type' END, CASE WHEN c THEN 'closed_at' END) AS broken FROM x WHERE t OR r OR c
""")  # fmt: skip
def _(spark, d):
    bad = {"title": F.when(F.col("id") % 8 == 0, " ").otherwise(F.col("title")), "remote_type": F.when(F.col("id") % 9 == 0, "home").otherwise(F.col("remote_type")), "closed_at": F.when(F.col("id") % 10 != 0, F.col("closed_at"))}
    rows = jobs(spark, d).withColumns(bad)
    return schema.split_by(rows, schema.job_expectations())[1].select("id", F.array_join("broken", ",").alias("broken"))


@query("set_active", f"WITH {TARGETS} SELECT id, is_active AND id % 7 <> 0 AS is_active, is_active AND id % 7 = 0 AS changed FROM targets")
def _(spark, d):
    stamp = F.lit(datetime(1998, 1, 1)).cast("timestamp")
    stored = targets(spark, d).withColumn("updated_at", stamp)
    rows, _ = snapshot.set_column(stored, stored.where("id % 7 = 0").select("id", F.lit(False).alias("value")), "is_active", NOW)
    return rows.select("id", "is_active", (F.col("updated_at") != stamp).alias("changed"))


@query("target_upsert", f"""
WITH {TARGETS}, s AS (SELECT *, 'u' AS board_url FROM targets WHERE id % 3 <> 0), n AS (SELECT company_id + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS company_id, ats_provider, external_board_id, CASE WHEN id % 4 = 0 THEN 'v' END AS board_url, CASE WHEN id % 2 = 0 THEN 'ethiopia' END AS market FROM targets WHERE (id % 2 = 0 OR id % 3 = 0) AND company_id + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END > 0)
SELECT coalesce(s.ats_provider, n.ats_provider) AS ats_provider, lower(coalesce(s.external_board_id, n.external_board_id)) AS board, coalesce(s.company_id, n.company_id) AS company_id,
    CASE WHEN s.id IS NULL OR s.company_id = n.company_id THEN true ELSE s.is_active END AS is_active, CASE WHEN s.id IS NULL OR s.company_id = n.company_id THEN coalesce(n.board_url, s.board_url) ELSE s.board_url END AS board_url,
    CASE WHEN s.id IS NULL OR s.company_id = n.company_id THEN coalesce(n.market, s.market, 'worldwide') ELSE s.market END AS market
FROM s FULL JOIN n ON s.ats_provider = n.ats_provider AND s.external_board_id = n.external_board_id
""")  # fmt: skip
def _(spark, d):
    t = targets(spark, d)
    stamp, null = F.lit(datetime(1998, 1, 1)).cast("timestamp"), F.lit(None)
    stored = t.where("id % 3 <> 0").withColumns({"board_url": F.lit("u"), "discovery_metadata": F.create_map().cast("map<string,string>"), "created_at": stamp, "updated_at": stamp})
    batch = t.where("id % 2 = 0 or id % 3 = 0").select(
        (F.col("company_id") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("company_id"), "ats_provider", F.concat(F.lit(" "), F.upper("external_board_id")).alias("external_board_id"),
        F.when(F.col("id") % 4 == 0, "v").alias("board_url"), null.cast("map<string,string>").alias("discovery_metadata"), F.when(F.col("id") % 2 == 0, "ethiopia").alias("market"), F.col("id").alias("ord"),
    )
    rows, _ = snapshot.upsert_targets(stored, batch, NOW)
    return rows.select("ats_provider", F.lower("external_board_id").alias("board"), "company_id", "is_active", "board_url", "market")


@query("common_names", f"""
WITH {COMPANIES}, n AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Neon' WHEN 1 THEN 'Close.com' WHEN 2 THEN name ELSE 'Vault Labs' END AS name FROM companies) SELECT id, id % 5 IN (0, 1) AS common FROM n
""")  # fmt: skip
def _(spark, d):
    k = F.col("id") % 5
    name = F.when(k == 0, "Neon").when(k == 1, "Close.com").when(k == 2, F.col("name")).otherwise("Vault Labs")
    return companies(spark, d).select("id", discovery.is_common_name(name).alias("common"))


@query("slug_variants", f"""
WITH {COMPANIES} SELECT id, CASE id % 6 WHEN 0 THEN 'acme' || id || 'labsinc,acme' || id || '-labs-inc,acme' || id || 'labs,acme' || id || '-labs' WHEN 1 THEN 'basalt' || id || 'io,basalt' || id WHEN 2 THEN 'neon' || id
    WHEN 3 THEN 'neon' || id || 'ltd,neon' || id || '-ltd,neon' || id WHEN 4 THEN '' ELSE 'bluer' || id || ',blue-r' || id END AS slugs FROM companies
""")  # fmt: skip
def _(spark, d):
    name = F.expr("CASE id % 6 WHEN 0 THEN concat('Acme', id, ' Labs, Inc.') WHEN 1 THEN concat('Basalt', id, '.io') WHEN 2 THEN concat(' Neon', id) WHEN 3 THEN concat('NEON', id, ' Ltd') WHEN 4 THEN concat('ሰላም ', id) ELSE concat('Blue  R', id, '!') END")
    return companies(spark, d).select("id", F.array_join(discovery.slug_variants(name), ",").alias("slugs"))


@query("search_reasons", f"""
WITH {COMPANIES}, r AS (
    SELECT id, CASE WHEN id % 7 = 0 THEN 'not-a-job-url' WHEN id % 5 = 0 OR id % 11 = 0 THEN 'no-employer' WHEN id % 3 <> 0 AND id % 4 <> 0 AND id % 13 <> 0 THEN 'outside-ethiopia' END AS reason FROM companies
) SELECT reason, count(*) AS results FROM r WHERE reason IS NOT NULL GROUP BY reason
""")  # fmt: skip
def _(spark, d):
    url = F.expr("""CASE WHEN id % 7 = 0 THEN concat('https://x.example/', id) ELSE concat('https://', CASE WHEN id % 3 = 0 THEN 'et' ELSE 'www' END, '.linkedin.com/jobs/view/clerk-', id, '-',
        CASE WHEN id % 11 = 0 THEN 'x' ELSE 'at' END, '-', CASE WHEN id % 5 = 0 THEN 'confidential' ELSE concat('firm', id) END, '-', 4465000000 + id, CASE WHEN id % 2 = 0 THEN '?ref=x' ELSE '/' END) END""")
    snippet = F.expr("CASE WHEN id % 4 = 0 THEN 'Work in Addis Ababa.' WHEN id % 13 = 0 THEN 'No longer accepting applications' ELSE 'in Noida' END")
    rows = companies(spark, d).select(F.col("id").alias("ord"), url.alias("url"), F.concat(F.lit("Clerk "), "id").alias("title"), snippet.alias("snippet"), F.lit(None).cast("string").alias("date"))
    return search.reasons(search.results(rows, datetime(2026, 9, 20), timedelta(days=90)))


@query("boards_in_results", f"""
WITH {COMPANIES} SELECT name AS company_name, CASE id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' END AS ats_provider, CASE id % 4 WHEN 0 THEN 'g' || id WHEN 1 THEN 'L-' || id WHEN 2 THEN 'a_' || id END AS external_board_id,
    CASE WHEN id % 4 = 3 THEN 'no board found' END AS problem FROM companies
""")  # fmt: skip
def _(spark, d):
    c = companies(spark, d)
    urls = F.expr("""array(concat('https://', id, '.example/jobs'), CASE id % 4 WHEN 0 THEN concat('https://job-boards.greenhouse.io/g', id, '?x=1') WHEN 1 THEN concat('HTTPS://jobs.lever.co/L-', id) WHEN 2 THEN concat('http://jobs.ashbyhq.com/a_', id, '/1')
        ELSE 'https://boards.greenhouse.io/embed/job_board?for=x' END, concat('https://jobs.lever.co/', CASE WHEN id % 4 = 3 THEN 'late.' ELSE 'late' END))""")
    found = discovery.boards_found(c.select(F.col("name").alias("company_name"), F.posexplode(urls).alias("rank", "url")))
    return found.select("company_name", "ats_provider", "external_board_id", "problem")


@query("name_mentions", f"""
WITH {COMPANIES} SELECT id, id % 4 <> 1 AS mentioned, id % 3 <> 2 AS domain FROM companies
""")  # fmt: skip
def _(spark, d):
    text = F.expr("CASE id % 4 WHEN 0 THEN concat('At Ramp', id, ', we') WHEN 1 THEN concat('we ramp', id, ' up') WHEN 2 THEN concat('use gitlab', id, '!') ELSE concat('an ibm', id, ' shop') END")
    name = F.expr("CASE WHEN id % 4 < 2 THEN concat('Ramp', id) WHEN id % 4 = 2 THEN concat('GitLab', id) ELSE concat('IBM', id) END")
    said = F.expr("CASE id % 3 WHEN 0 THEN concat('see Mill', id, '.example/jobs') WHEN 1 THEN concat('jobs@mill', id, '.example.') ELSE concat('windmill', id, '.example and mill', id, '.examples') END")
    return companies(spark, d).select("id", discovery.mentions(text, name).alias("mentioned"), discovery.has_domain(said, F.expr("concat('mill', id, '.example')")).alias("domain"))
