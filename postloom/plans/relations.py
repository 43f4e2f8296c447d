"""The engine's tables, made from the driver's tables, as DataFrames and as the SQL they correspond to."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(1998, 1, 1)
SOURCES = ("greenhouse", "lever", "himalayas")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings."""
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(
        "o_orderkey AS id",
        "o_custkey AS company_id",
        "o_custkey * 10 + o_orderkey % 3 AS target_company_id",
        "CASE o_orderkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'himalayas' END AS source",
        "CAST(o_orderkey AS STRING) AS source_job_id",
        "CAST(NULL AS STRING) AS canonical_url",
        "concat(o_orderpriority, ' Engineer #', CAST(o_orderkey % 50 AS STRING)) AS title",
        "concat('Order of ', CAST(o_custkey AS STRING)) AS description",
        "concat('https://example.com/', CAST(o_orderkey AS STRING)) AS application_url",
        "CASE o_orderkey % 5 WHEN 0 THEN 'Addis Ababa' WHEN 1 THEN 'Ethiopia' WHEN 2 THEN 'Nairobi, Kenya' WHEN 3 THEN NULL ELSE 'Addis, Ethiopia' END AS location_raw",
        "CASE o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' ELSE 'unknown' END AS remote_type",
        "CASE o_orderkey % 7 WHEN 0 THEN 'contract' WHEN 1 THEN 'part_time' ELSE 'full_time' END AS employment_type",
        "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS published_at",
        "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS first_seen_at",
        "CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(CAST(1 + o_orderkey % 60 AS INT)) AS last_seen_at",
        "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS last_changed_at",
        "CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 DAY END AS closed_at",
        "CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 400 DAY END AS expires_at",
        "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'removed' END AS status",
        "CAST(o_orderkey % 1000 AS STRING) AS content_hash",
        "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS created_at",
        "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY AS updated_at",
    )


JOBS = """
jobs AS (
    SELECT o_orderkey AS id, o_custkey AS company_id, o_custkey * 10 + o_orderkey % 3 AS target_company_id,
        CASE o_orderkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'himalayas' END AS source,
        CAST(o_orderkey AS VARCHAR) AS source_job_id, o_orderpriority || ' Engineer #' || (o_orderkey % 50) AS title, 'Order of ' || o_custkey AS description,
        'https://example.com/' || o_orderkey AS application_url,
        CASE o_orderkey % 5 WHEN 0 THEN 'Addis Ababa' WHEN 1 THEN 'Ethiopia' WHEN 2 THEN 'Nairobi, Kenya' WHEN 3 THEN NULL ELSE 'Addis, Ethiopia' END AS location_raw,
        CASE o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' ELSE 'unknown' END AS remote_type,
        CASE o_orderkey % 7 WHEN 0 THEN 'contract' WHEN 1 THEN 'part_time' ELSE 'full_time' END AS employment_type,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS published_at, o_orderdate + INTERVAL 1 DAY AS first_seen_at,
        o_orderdate + to_days(CAST(1 + o_orderkey % 60 AS INTEGER)) AS last_seen_at, o_orderdate + INTERVAL 1 DAY AS last_changed_at,
        CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 90 DAY END AS closed_at,
        CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate + INTERVAL 400 DAY END AS expires_at,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'removed' END AS status, CAST(o_orderkey % 1000 AS VARCHAR) AS content_hash
    FROM orders
)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "concat('https://', CAST(c_custkey AS STRING), '.example/') AS website", "c_mktsegment = 'BUILDING' AS is_priority", "c_nationkey AS nation")


COMPANIES = """
companies AS (
    SELECT c_custkey AS id, c_name AS name, 'https://' || c_custkey || '.example/' AS website, c_mktsegment = 'BUILDING' AS is_priority, c_nationkey AS nation FROM customer
)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boards for each customer, one of each source."""
    c = table(spark, sf_dir, "customer")
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    rows = c.select("c_custkey", "c_nationkey", k.alias("k"))
    return rows.selectExpr(
        "c_custkey * 10 + k AS id",
        "c_custkey AS company_id",
        "CASE k WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'himalayas' END AS ats_provider",
        "concat('board-', CAST(c_custkey AS STRING), '-', CAST(k AS STRING)) AS external_board_id",
        "(c_custkey + k) % 4 <> 0 AS is_active",
        "CASE WHEN (c_custkey + k) % 3 <> 0 THEN TIMESTAMP '1997-06-01 00:00:00' END AS last_successful_ingestion_at",
        "CASE WHEN c_nationkey % 5 = 0 THEN 'ethiopia' ELSE 'worldwide' END AS market",
    )


TARGETS = """
targets AS (
    SELECT c_custkey * 10 + k AS id, c_custkey AS company_id, CASE k WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'himalayas' END AS ats_provider,
        'board-' || c_custkey || '-' || k AS external_board_id, (c_custkey + k) % 4 <> 0 AS is_active,
        CASE WHEN (c_custkey + k) % 3 <> 0 THEN TIMESTAMP '1997-06-01 00:00:00' END AS last_successful_ingestion_at,
        CASE WHEN c_nationkey % 5 = 0 THEN 'ethiopia' ELSE 'worldwide' END AS market
    FROM customer, (VALUES (0), (1), (2)) t(k)
)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the orders have a verdict."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 1")
    return o.selectExpr(
        "o_orderkey AS job_id",
        "'ET' AS target_country",
        "CASE o_orderkey % 4 WHEN 0 THEN 'eligible' WHEN 1 THEN 'ineligible' ELSE 'uncertain' END AS status",
        "CAST(0.25 * (o_orderkey % 4) AS DECIMAL(3,2)) AS confidence",
        "'no_signal' AS basis",
        "array('a', CAST(o_orderkey % 10 AS STRING)) AS reasons",
        "array(named_struct('field', 'title', 'text', 'x')) AS evidence",
        "array() AS restrictions",
        "CAST(NULL AS STRING) AS hours_constraint",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'software' ELSE 'sales' END AS role_family",
        "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 2 = 0 END AS relevant",
        "CAST(1 + o_orderkey % 2 AS INT) AS classifier_version",
        "CAST(o_orderkey % 1000 AS STRING) AS job_content_hash",
    )


VERDICTS = """
verdicts AS (
    SELECT o_orderkey AS job_id, 'ET' AS target_country, CASE o_orderkey % 4 WHEN 0 THEN 'eligible' WHEN 1 THEN 'ineligible' ELSE 'uncertain' END AS status,
        0.25 * (o_orderkey % 4) AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'software' ELSE 'sales' END AS role_family,
        CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 2 = 0 END AS relevant, 1 + o_orderkey % 2 AS classifier_version, CAST(o_orderkey % 1000 AS VARCHAR) AS job_content_hash
    FROM orders WHERE o_orderkey % 3 <> 1
)"""

#: All of them, and the postings with their company, board and verdict.
WITH = f"WITH {JOBS}, {COMPANIES}, {TARGETS}, {VERDICTS}"
ROWS = f"""{WITH}, open_jobs AS (
    SELECT j.*, c.name AS company, c.is_priority, CASE WHEN c.is_priority THEN 'ethiopia' ELSE t.market END AS market, coalesce(j.published_at, j.first_seen_at) AS posted_at,
        v.status AS verdict, v.confidence, v.relevant, v.role_family
    FROM jobs j JOIN companies c ON c.id = j.company_id JOIN targets t ON t.id = j.target_company_id LEFT JOIN verdicts v ON v.job_id = j.id
    WHERE j.status = 'open' AND (j.expires_at IS NULL OR j.expires_at > TIMESTAMP '1998-01-01 00:00:00')
)"""
