"""Queries of the read side, the reports and the snapshot changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators import listing, reports, snapshot
from postloom.operators.listing import Filter
from postloom.plans.relations import AS_OF, COMPANIES, JOBS, ROWS, TARGETS, VERDICTS, WITH, companies, jobs, targets, verdicts

NOW = datetime(1998, 9, 1)
PAGE_COLUMNS = ("id", "company", "title", "location_raw", "remote_type", "employment_type", "market", "posted_at")


def repository(spark: SparkSession, d: str) -> listing.JobsRepository:
    return listing.JobsRepository(jobs(spark, d), companies(spark, d), targets(spark, d), verdicts(spark, d))


def rows(spark: SparkSession, d: str) -> DataFrame:
    return repository(spark, d).rows


def plain(df: DataFrame) -> DataFrame:
    return df.select(*PAGE_COLUMNS, F.col("eligibility.status").alias("verdict"), F.col("eligibility.confidence").alias("confidence"), "relevant", "role_family", *([c for c in ("total",) if c in df.columns]))


SELECT = "id, company, title, location_raw, remote_type, employment_type, market, posted_at, verdict, CAST(confidence AS DOUBLE) AS confidence, relevant, role_family"


def page(f: Filter):
    return lambda spark, d: plain(repository(spark, d).list(f, AS_OF))


def page_sql(where: str, limit: int = 20, offset: int = 0) -> str:
    return f"{ROWS}, f AS (SELECT * FROM open_jobs WHERE {where}) SELECT {SELECT}, (SELECT count(*) FROM f) AS total FROM f ORDER BY posted_at DESC, id DESC LIMIT {limit} OFFSET {offset}"


def count(f: Filter):
    return lambda spark, d: repository(spark, d).total(f, AS_OF)


PAGES = {
    "jobs_first_page": (Filter(), "true", 20, 0),
    "jobs_third_page": (Filter(page=3, page_size=50), "true", 50, 100),
    "jobs_past_the_end": (Filter(page=100_000_000, page_size=100), "false", 1, 0),
    "jobs_by_types": (Filter(remote_type="remote", employment_type="contract"), "remote_type = 'remote' AND employment_type = 'contract'", 20, 0),
    "jobs_priority_market": (Filter(priority_only=True, market="ethiopia"), "is_priority AND market = 'ethiopia'", 20, 0),
    "jobs_worldwide": (Filter(market="worldwide", page_size=100), "market = 'worldwide'", 100, 0),
    "jobs_eligibility_in": (Filter(eligibility=["eligible", "unclassified"], page_size=100), "coalesce(verdict, 'unclassified') IN ('eligible', 'unclassified')", 100, 0),
    "jobs_relevant_family": (Filter(relevant_only=True, role_family="software"), "relevant AND role_family = 'software'", 20, 0),
    "jobs_search": (Filter(query="URGENT engineer #1", page_size=100), "contains(lower(title), 'urgent engineer #1') OR contains(lower(company), 'urgent engineer #1')", 100, 0),
    "jobs_of_company": (Filter(company="customer#000000010"), "lower(company) = 'customer#000000010'", 20, 0),
    "jobs_max_age": (Filter(max_age_seconds=200 * 86400, page_size=100), "posted_at >= TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 200 DAY", 100, 0),
    "jobs_by_tag": (Filter(tag="go"), "false", 20, 0),
}
QUERIES = {name: page(f) for name, (f, *_) in PAGES.items()}
ORACLES = {name: page_sql(*more) for name, (_, *more) in PAGES.items()}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


ODD_TITLES = ("Deal 100%_\\ now", "deal 100%_ \\ now", "100X_\\", "Plain", "SALE 100%_\\")


@query("jobs_search_escapes", page_sql("id % 5 IN (0, 4)", 30).replace("SELECT id, company, title,", f"SELECT id, company, CASE id % 5 {' '.join(f'WHEN {k} THEN {chr(39)}{t}{chr(39)}' for k, t in enumerate(ODD_TITLES))} END AS title,"))
def _(spark, d):
    """What means something in a LIKE pattern means itself in a search."""
    r = repository(spark, d)
    r.bare = r.bare.withColumn("title", F.get(F.array(*map(F.lit, ODD_TITLES)), (F.col("id") % 5).cast("int")))
    return plain(r.list(Filter(query="100%_\\", page_size=30), AS_OF))


@query("jobs_total", f"{ROWS} SELECT count(*) AS total FROM open_jobs WHERE remote_type = 'remote'")
def _(spark, d):
    return count(Filter(remote_type="remote"))(spark, d)


@query("job_by_id", f"{ROWS} SELECT {SELECT} FROM open_jobs WHERE id = (SELECT max(id) FROM open_jobs WHERE id % 3 = 0)")
def _(spark, d):
    r = rows(spark, d).where(listing.is_open(AS_OF))
    one = r.where("id % 3 = 0").agg(F.max("id").alias("id"))
    return plain(r.join(F.broadcast(one), "id", "left_semi"))  # one row


@query("provider_subset", f"{WITH} SELECT id, ats_provider FROM targets WHERE ats_provider IN ('lever', 'himalayas') AND is_active")
def _(spark, d):
    return targets(spark, d).where(F.col("ats_provider").isin("lever", "himalayas") & F.col("is_active")).select("id", "ats_provider")


@query("eligibility_counts", f"{WITH} SELECT coalesce(v.status, 'unclassified') AS status, count(*) AS jobs FROM jobs j LEFT JOIN verdicts v ON v.job_id = j.id WHERE j.status = 'open' GROUP BY 1")
def _(spark, d):
    return reports.eligibility_counts(jobs(spark, d), verdicts(spark, d))


@query("pending_verdicts", f"{WITH} SELECT j.id FROM jobs j LEFT JOIN verdicts v ON v.job_id = j.id WHERE j.status = 'open' AND (v.job_id IS NULL OR v.classifier_version <> 2 OR v.target_country <> 'ET' OR v.job_content_hash IS DISTINCT FROM j.content_hash)")
def _(spark, d):
    return reports.pending_verdicts(jobs(spark, d), verdicts(spark, d), 2, "ET").select("id")


@query("companies_without_board", f"{WITH} SELECT DISTINCT name FROM companies c WHERE EXISTS (SELECT 1 FROM targets t WHERE t.company_id = c.id AND t.ats_provider = 'himalayas') AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.company_id = c.id AND t.ats_provider IN ('lever') AND t.is_active)")
def _(spark, d):
    return reports.names_without_board(companies(spark, d), targets(spark, d), ["himalayas"], ["lever"])


@query("companies_with_board", f"{WITH} SELECT DISTINCT name FROM companies c JOIN targets t ON t.company_id = c.id WHERE t.ats_provider = 'lever' AND t.is_active")
def _(spark, d):
    return reports.names_with_board(companies(spark, d), targets(spark, d), ["lever"])


@query("companies_with_source_and_board", f"{WITH} SELECT DISTINCT name FROM companies c JOIN targets s ON s.company_id = c.id AND s.ats_provider = 'himalayas' JOIN targets b ON b.company_id = c.id AND b.ats_provider = 'greenhouse' AND b.is_active")
def _(spark, d):
    return reports.names_with_source_and_board(companies(spark, d), targets(spark, d), ["himalayas"], ["greenhouse"])


@query("targets_by_company_names", f"{WITH} SELECT t.id, c.name AS company, t.external_board_id FROM targets t JOIN companies c ON c.id = t.company_id WHERE lower(c.name) IN ('customer#000000001', 'customer#000000007') AND t.ats_provider IN ('lever', 'greenhouse')")
def _(spark, d):
    return reports.targets_of(companies(spark, d), targets(spark, d), [" Customer#000000001", "customer#000000007"], ["lever", "greenhouse"]).select("id", "company", "external_board_id")


@query("open_openings_other_sources", f"{ROWS} SELECT company_id, id, title, location_raw FROM open_jobs WHERE market = 'ethiopia' AND source <> 'lever'")
def _(spark, d):
    return reports.open_openings(jobs(spark, d), companies(spark, d), targets(spark, d), "ethiopia", "lever", AS_OF)


@query("titles_per_company_top_n", f"{WITH}, t AS (SELECT DISTINCT lower(c.name) AS company, title FROM jobs j JOIN companies c ON c.id = j.company_id WHERE source IN ('lever', 'himalayas')), r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY title) AS place FROM t) SELECT * FROM r WHERE place <= 3")
def _(spark, d):
    return reports.titles_by_company(jobs(spark, d), companies(spark, d), ["lever", "himalayas"], 3)


COVERAGE = f"""{WITH}, n AS (
    SELECT company_id, source, count(*) AS n FROM jobs WHERE status = 'open' AND (expires_at IS NULL OR expires_at > TIMESTAMP '1998-01-01 00:00:00') GROUP BY ALL
), s AS (SELECT company_id, sum(n) AS open_jobs, string_agg(source || '=' || n, ' ' ORDER BY source) AS by_source FROM n GROUP BY ALL
), b AS (SELECT company_id, string_agg(ats_provider || CASE WHEN NOT is_active THEN '(inactive)' WHEN last_successful_ingestion_at IS NULL THEN '(never ingested)' ELSE '' END, ' ' ORDER BY ats_provider, external_board_id) AS boards FROM targets GROUP BY ALL
), report AS (
    SELECT c.name, CAST(coalesce(s.open_jobs, 0) AS BIGINT) AS open_jobs, coalesce(s.by_source, '-') AS by_source, coalesce(b.boards, 'none') AS boards
    FROM companies c LEFT JOIN s ON s.company_id = c.id LEFT JOIN b ON b.company_id = c.id WHERE c.is_priority
)"""


@query("coverage_report", f"{COVERAGE} SELECT * FROM report")
def _(spark, d):
    return reports.coverage(jobs(spark, d), companies(spark, d), targets(spark, d), AS_OF)


@query("coverage_headline", f"{COVERAGE}, e AS (SELECT name FROM companies WHERE id % 7 = 0), m AS (SELECT count(*) AS missing FROM e WHERE lower(name) NOT IN (SELECT lower(name) FROM report)) SELECT (SELECT count(*) FROM report WHERE open_jobs > 0) AS with_jobs, (SELECT count(*) FROM report) + missing AS companies, missing, (SELECT CAST(sum(open_jobs) AS BIGINT) FROM report) AS total_open FROM m")
def _(spark, d):
    c = companies(spark, d)
    report = reports.coverage(jobs(spark, d), c, targets(spark, d), AS_OF)
    return reports.coverage_headline(report, c.where("id % 7 = 0").select("name"))


@query("confusion_metrics", """
WITH r AS (SELECT CAST(quality AS VARCHAR) AS g, CAST(toxic AS VARCHAR) AS p FROM labels), l AS (SELECT g AS label FROM r UNION SELECT p FROM r)
SELECT label, count(*) FILTER (WHERE g = label) AS gold, count(*) FILTER (WHERE p = label) AS predicted, count(*) FILTER (WHERE g = label AND p = label) AS both,
    CASE WHEN count(*) FILTER (WHERE p = label) > 0 THEN count(*) FILTER (WHERE g = label AND p = label) / count(*) FILTER (WHERE p = label) ELSE 0 END AS precision,
    CASE WHEN count(*) FILTER (WHERE g = label) > 0 THEN count(*) FILTER (WHERE g = label AND p = label) / count(*) FILTER (WHERE g = label) ELSE 0 END AS recall,
    count(*) FILTER (WHERE g = p) / count(*) AS accuracy
FROM l, r GROUP BY label
""")  # fmt: skip
def _(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return reports.confusion(labels.selectExpr("CAST(quality AS STRING) AS gold", "CAST(toxic AS STRING) AS predicted"))


# Snapshots: the stored table is all orders but every tenth; what arrives is every third, some with other texts or owners.
BATCH = """
b AS (
    SELECT company_id + CASE WHEN id % 21 = 0 THEN 1 ELSE 0 END AS company_id, target_company_id, source, source_job_id, CASE WHEN id % 2 = 0 THEN title || ' II' ELSE title END AS title,
        description, application_url, location_raw, CASE WHEN id % 4 <> 0 THEN published_at END AS published_at, expires_at, CASE WHEN id % 6 = 0 THEN '' ELSE 'remote' END AS remote_type, '' AS employment_type
    FROM jobs WHERE id % 3 = 0
), h AS (
    SELECT *, sha256(title || chr(0) || description || chr(0) || application_url || chr(0) || chr(0) || coalesce(location_raw, '') || chr(0) || CASE WHEN remote_type <> '' THEN remote_type || chr(0) ELSE '' END) AS hash FROM b
), s AS (SELECT * FROM jobs WHERE id % 10 <> 0)"""


def stored_and_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    j = jobs(spark, d)
    b = j.where("id % 3 = 0").selectExpr(
        "CAST(company_id + CASE WHEN id % 21 = 0 THEN 1 ELSE 0 END AS BIGINT) AS company_id", "target_company_id", "source", "source_job_id", "canonical_url", "CASE WHEN id % 2 = 0 THEN concat(title, ' II') ELSE title END AS title",
        "description", "application_url", "location_raw", "CASE WHEN id % 4 <> 0 THEN published_at END AS published_at", "expires_at", "CASE WHEN id % 6 = 0 THEN '' ELSE 'remote' END AS remote_type", "'' AS employment_type", "id AS ord",
    )
    return j.where("id % 10 <> 0"), b


@query("upsert_snapshot", f"""WITH {JOBS}, {BATCH}, j AS (
    SELECT s.id, coalesce(s.source, h.source) AS source, coalesce(s.source_job_id, h.source_job_id) AS source_job_id, s.id IS NULL AS fresh,
        h.source IS NOT NULL AND s.company_id = h.company_id AND s.target_company_id = h.target_company_id AS fits, s.title AS st, h.title AS ht, s.content_hash AS sh, h.hash AS hh, s.status AS ss,
        s.published_at AS sp, h.published_at AS hp, s.remote_type AS sr, h.remote_type AS hr, s.employment_type AS se, s.last_changed_at AS sc, s.last_seen_at AS sl, s.closed_at AS sd
    FROM s FULL JOIN h ON s.source = h.source AND s.source_job_id = h.source_job_id
)
SELECT source, source_job_id, CASE WHEN fresh OR fits THEN ht ELSE st END AS title, CASE WHEN fresh OR fits THEN hh ELSE sh END AS content_hash, CASE WHEN fresh OR fits THEN 'open' ELSE ss END AS status,
    CASE WHEN fresh OR fits THEN coalesce(hp, sp) ELSE sp END AS published_at, CASE WHEN fresh THEN coalesce(nullif(hr, ''), 'unknown') WHEN fits THEN coalesce(nullif(hr, ''), sr) ELSE sr END AS remote_type,
    CASE WHEN fresh THEN 'unknown' ELSE se END AS employment_type, CASE WHEN fresh OR (fits AND (sh IS DISTINCT FROM hh OR ss <> 'open')) THEN TIMESTAMP '1998-09-01 00:00:00' ELSE sc END AS last_changed_at,
    CASE WHEN fresh OR fits THEN TIMESTAMP '1998-09-01 00:00:00' ELSE sl END AS last_seen_at, CASE WHEN fresh OR fits THEN NULL ELSE sd END AS closed_at
FROM j""")
def _(spark, d):
    old, batch = stored_and_batch(spark, d)
    out = snapshot.upsert_jobs(old, batch, NOW).rows
    return out.select("source", "source_job_id", "title", "content_hash", "status", "published_at", "remote_type", "employment_type", "last_changed_at", "last_seen_at", "closed_at")


@query("upsert_outcome_counts", f"""WITH {JOBS}, {BATCH}, o AS (
    SELECT CASE WHEN s.id IS NULL THEN 'inserted' WHEN s.company_id <> h.company_id OR s.target_company_id <> h.target_company_id THEN 'mismatch' WHEN s.content_hash IS DISTINCT FROM h.hash OR s.status <> 'open' THEN 'changed' ELSE 'unchanged' END AS o
    FROM h LEFT JOIN s ON s.source = h.source AND s.source_job_id = h.source_job_id
) SELECT count(*) FILTER (WHERE o = 'inserted') AS inserted, count(*) FILTER (WHERE o = 'changed') AS changed, count(*) FILTER (WHERE o = 'unchanged') AS unchanged, count(*) FILTER (WHERE o = 'mismatch') AS mismatch FROM o""")
def _(spark, d):
    return reports.outcome_counts(snapshot.upsert_jobs(*stored_and_batch(spark, d), NOW).outcomes)


CLOSED = "id, CASE WHEN hit THEN '{0}' ELSE status END AS status, CASE WHEN hit THEN TIMESTAMP '1998-09-01 00:00:00' ELSE closed_at END AS closed_at"


@query("mark_missing", f"WITH {JOBS}, h AS (SELECT *, status = 'open' AND target_company_id % 10 = 1 AND company_id IN (1, 2, 4, 5, 7, 8) AND id % 4 <> 0 AS hit FROM jobs) SELECT {CLOSED.format('removed')} FROM h")
def _(spark, d):
    j = jobs(spark, d)
    return snapshot.mark_missing(j, j.where("id % 4 = 0"), [11, 21, 41, 51, 71, 81], NOW).select("id", "status", "closed_at")


@query("close_stale", f"WITH {JOBS}, h AS (SELECT *, status = 'open' AND last_seen_at < TIMESTAMP '1998-09-01 00:00:00' - INTERVAL 100 DAY AS hit FROM jobs) SELECT {CLOSED.format('closed')} FROM h")
def _(spark, d):
    return snapshot.close_stale(jobs(spark, d), 100 * 86400, NOW).select("id", "status", "closed_at")


@query("close_by_id", f"WITH {JOBS}, h AS (SELECT *, status = 'open' AND id % 17 = 0 AS hit FROM jobs) SELECT {CLOSED.format('closed')} FROM h")
def _(spark, d):
    j = jobs(spark, d)
    return snapshot.close_by_id(j, j.where("id % 17 = 0"), NOW).select("id", "status", "closed_at")


@query("move_jobs", f"WITH {JOBS} SELECT id, CASE WHEN id % 19 = 0 THEN target_company_id + 10 ELSE target_company_id END AS target_company_id, CASE WHEN id % 19 = 0 THEN company_id + 1 ELSE company_id END AS company_id FROM jobs")
def _(spark, d):
    j = jobs(spark, d)
    moves = j.where("id % 19 = 0").selectExpr("source", "source_job_id", "target_company_id + 10 AS target_company_id", "company_id + 1 AS company_id")
    return snapshot.move_jobs(j, moves, NOW).select("id", "target_company_id", "company_id")


@query("run_log_latest", "SELECT event_type AS name, max(ts) AS last_run_at FROM events GROUP BY 1")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("concat(' ', event_type) AS name", "CAST(ts AS TIMESTAMP) AS last_run_at", "event_id")
    return snapshot.record_runs(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"))


@query("company_upsert_fill", f"""WITH {COMPANIES}, o AS (SELECT name, CASE WHEN id % 2 = 0 THEN website END AS website FROM companies WHERE id % 3 <> 0), n AS (SELECT upper(name) AS name, website || 'new' AS website FROM companies WHERE id % 4 = 0)
SELECT coalesce(o.name, n.name) AS name, coalesce(o.website, n.website) AS website FROM o FULL JOIN n ON lower(o.name) = lower(n.name)""")
def _(spark, d):
    c = companies(spark, d)
    null = F.lit(None)
    old = c.where("id % 3 <> 0").select("id", "name", F.when(F.col("id") % 2 == 0, F.col("website")).alias("website"), null.cast("string").alias("description"), F.lit("active").alias("status"), "is_priority", F.lit(AS_OF).alias("created_at"), F.lit(AS_OF).alias("updated_at"))
    new = c.where("id % 4 = 0").select(F.concat(F.lit("  "), F.upper("name")).alias("name"), F.concat("website", F.lit("new")).alias("website"), null.cast("string").alias("description"), F.col("id").alias("ord"))
    return snapshot.upsert_companies(old, new, NOW).select("name", "website")


@query("save_verdicts", f"WITH {JOBS}, {VERDICTS}, a AS (SELECT job_id, 'uncertain' AS status FROM verdicts WHERE job_id % 5 = 0 AND job_id IN (SELECT id FROM jobs)) SELECT job_id, status FROM a UNION ALL SELECT job_id, status FROM verdicts WHERE job_id NOT IN (SELECT job_id FROM a)")
def _(spark, d):
    v = verdicts(spark, d).select("job_id", "status")
    arriving = v.where("job_id % 5 = 0").select("job_id", F.lit("uncertain").alias("status"), F.lit(0).alias("ord"))
    stray = arriving.select((-F.col("job_id") - 1).alias("job_id"), "status", "ord")
    return snapshot.save_verdicts(v, arriving.unionByName(stray), jobs(spark, d))
