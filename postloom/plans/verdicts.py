"""Queries of the eligibility rules: places, time windows and verdicts over the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import zones
from postloom.functions.gazetteer import gazetteer
from postloom.operators import eligibility
from postloom.plans.relations import AS_OF, WITH, jobs, table, verdicts
from postloom.session import ship

#: Postings by shape, and what the rules have to say of each: status, confidence, basis.
SHAPES = (
    ("himalayas", "Analyst", "Anywhere", "remote", "We keep books for small shops.", "eligible", 0.9, "worldwide"),
    ("remotive", "Analyst", "Africa, Middle East", "remote", "We keep books for small shops.", "eligible", 0.9, "region_includes_africa"),
    ("jobicy", "Analyst", "Canada or Chile", "remote", "We keep books for small shops.", "ineligible", 0.9, "restricted_places"),
    ("remotive", "Analyst", "Anywhere except Africa", "remote", "We keep books.", "ineligible", 0.9, "excluded"),
    ("workingnomads", "Analyst", "EET (+/- 2 hours)", "remote", "We keep books.", "eligible", 0.8, "timezone_window"),
    ("workingnomads", "Analyst", "UTC-7 to UTC-4", "remote", "We keep books.", "ineligible", 0.7, "timezone_outside"),
    ("lever", "Analyst", "Kampala, Uganda", "onsite", "We keep books.", "ineligible", 0.75, "onsite_elsewhere"),
    ("lever", "Analyst", "Hawassa", "onsite", "We keep books.", "eligible", 0.95, "local_ethiopia"),
    ("lever", "Analyst", "Norway", "unknown", "We keep books.", "ineligible", 0.6, "restricted_places"),
    ("lever", "Analyst", "Oslo", "unknown", "We keep books.", "uncertain", 0.4, "no_signal"),
    ("lever", "Analyst", "Oslo", "unknown", "You will be based in the centre of town.", "ineligible", 0.75, "onsite_elsewhere"),
    ("greenhouse", "Analyst", "Remote", "remote", "Applicants must reside in Sweden or Finland.", "ineligible", 0.85, "restricted_places"),
    ("greenhouse", "Analyst", "Remote", "remote", "You need the right to work in Japan.", "ineligible", 0.8, "work_authorization"),
    ("greenhouse", "Analyst", "Remote", "remote", "Applicants may be based anywhere.", "eligible", 0.8, "explicit_permission"),
    ("greenhouse", "Analyst (Brazil only)", "Remote, Global", "remote", "We keep books.", "ineligible", 0.85, "restricted_places"),
    ("himalayas", "Analyst", "Worldwide", "remote", "Location: Portugal (remote)", "uncertain", 0.3, "conflicting_signals"),
    ("greenhouse", "Analyst", None, "hybrid", None, "uncertain", 0.2, "no_signal"),
)


def _text(x: object) -> str:
    return "CAST(NULL AS STRING)" if x is None else f"'{x}'"


def postings(spark: SparkSession, d: str) -> DataFrame:
    """The postings of relations.jobs, in turn in each of the shapes; descriptions keep a line of their own."""
    pick = lambda k: F.expr(f"element_at(array({', '.join(_text(s[k]) for s in SHAPES)}), CAST(id % {len(SHAPES)} AS INT) + 1)")
    rows = jobs(spark, d).select("id", "status", "content_hash", "description")
    shaped = {"source": pick(0), "title": pick(1), "location_raw": pick(2), "remote_type": pick(3), "market": F.lit("worldwide")}
    said = F.when(F.expr(f"id % {len(SHAPES)} = {len(SHAPES) - 1}"), None).otherwise(F.concat_ws("\n", "description", pick(4)))
    return rows.select("id", "status", "content_hash", *(c.alias(n) for n, c in shaped.items()), said.alias("description"))


def eligibility_verdicts(spark: SparkSession, d: str) -> DataFrame:
    out = eligibility.classified(postings(spark, d), gazetteer(spark), AS_OF)
    return out.select("job_id", "target_country", "status", F.col("confidence").cast("double").alias("confidence"), "basis", "classifier_version", "job_content_hash", "failed")


def eligibility_run_stats(spark: SparkSession, d: str) -> DataFrame:
    """A run over the open postings whose verdict is missing or old."""
    from postloom.operators import reports

    pending = reports.pending_verdicts(postings(spark, d), verdicts(spark, d), eligibility.VERSION, "ET")
    return eligibility.stats(eligibility.classified(pending, gazetteer(spark), AS_OF))


def _shapes_sql() -> str:
    values = ", ".join(f"({k}, '{s[5]}', CAST({s[6]} AS DOUBLE), '{s[7]}')" for k, s in enumerate(SHAPES))
    return f"shapes(k, status, confidence, basis) AS (VALUES {values})"


#: Texts and the places that stand in them, in order.
PLACES = (
    ("Kenya, Uganda", "Kenya|Uganda"), ("U.S. or the U.K.", "United States|United Kingdom"), ("Remote, DE", "Germany"), ("Portland, OR", "Portland"), ("São Paulo & Lima", "Sao Paulo|Lima"),
    ("South Africa (not Africa)", "South Africa|Africa"), ("anywhere in the world", "Worldwide"), ("US, CA", "United States|Canada"), ("IT IS ME", ""), ("Hawassa; Dire Dawa", "Hawassa|Dire Dawa"),
    ("DACH, Nordics", "DACH|Nordics"), ("Papua New Guinea", "Papua New Guinea"), ("excluding FR and PL", "France|Poland"),
)


def scanned_places(spark: SparkSession, d: str) -> DataFrame:
    """The places that a scan finds in each customer's text."""
    ship(spark)
    sent = spark.sparkContext.broadcast(gazetteer(spark))

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "|".join(m.place.name for m in sent.value.scan(t)))

    text = F.expr(f"element_at(array({', '.join(_text(t) for t, _ in PLACES)}), CAST(c_custkey % {len(PLACES)} AS INT) + 1)")
    return table(spark, d, "customer").select("c_custkey", found(F.concat_ws(" - ", "c_name", text)).alias("places"))


def zone_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of offsets written in three ways."""
    ship(spark)

    @F.pandas_udf("array<struct<low:double,high:double>>")
    def windows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"low": float(w.low), "high": float(w.high)} for w in zones.time_windows(t)])

    c = table(spark, d, "customer").selectExpr("c_custkey AS id", "CAST(c_custkey % 12 AS STRING) AS a", "CAST(c_custkey % 5 AS STRING) AS b")
    text = F.expr("CASE id % 3 WHEN 0 THEN concat('UTC+', a, ' to UTC-', b) WHEN 1 THEN concat('GMT -', a, ':30, flexible') ELSE concat('within ', b, ' hours of CET') END")
    return c.select("id", F.explode(windows(text)).alias("w")).selectExpr("id", "w.low + 0.0D AS low", "w.high + 0.0D AS high")


QUERIES = {"eligibility_verdicts": eligibility_verdicts, "eligibility_run_stats": eligibility_run_stats, "scanned_places": scanned_places, "zone_windows": zone_windows}
ORACLES = {
    "eligibility_verdicts": f"{WITH}, {_shapes_sql()} SELECT id AS job_id, 'ET' AS target_country, s.status, s.confidence, s.basis, CAST(1 AS INTEGER) AS classifier_version, content_hash AS job_content_hash, false AS failed FROM jobs JOIN shapes s ON id % {len(SHAPES)} = k",
    "eligibility_run_stats": f"""{WITH}, {_shapes_sql()}, p AS (
    SELECT j.id FROM jobs j LEFT JOIN verdicts v ON v.job_id = j.id
    WHERE j.status = 'open' AND (v.job_id IS NULL OR v.classifier_version <> 1 OR v.target_country <> 'ET' OR v.job_content_hash IS DISTINCT FROM j.content_hash)
)
SELECT count(*) AS classified, count(*) FILTER (s.status = 'eligible') AS eligible, count(*) FILTER (s.status = 'ineligible') AS ineligible, count(*) FILTER (s.status = 'uncertain') AS uncertain, CAST(0 AS BIGINT) AS failed
FROM p JOIN shapes s ON id % {len(SHAPES)} = k""",
    "scanned_places": f"SELECT c_custkey, p.places FROM customer JOIN (VALUES {', '.join(f'({k}, {_text(p)})' for k, (_, p) in enumerate(PLACES))}) p(k, places) ON c_custkey % {len(PLACES)} = k",
    "zone_windows": """
WITH c AS (SELECT c_custkey AS id, CAST(c_custkey % 12 AS DOUBLE) AS a, CAST(c_custkey % 5 AS DOUBLE) AS b FROM customer)
SELECT id, CASE id % 3 WHEN 0 THEN -b WHEN 1 THEN -a - 0.5 ELSE 1 - b END + 0.0 AS low, CASE id % 3 WHEN 0 THEN a WHEN 1 THEN -a - 0.5 ELSE 1 + b END + 0.0 AS high FROM c""",
}
