"""The registered queries over the driver's tables and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.plans import bodies, relational, rules, scalars, texts, verdicts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def list_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings, labels as verdicts: the third page of a filtered, searched listing with its total."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    verdicts = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    status = F.coalesce(F.col("quality").cast("string"), F.lit("unclassified"))
    found = docs.join(verdicts, "doc_id", "left").select("doc_id", "source", "n_chars", status.alias("status"), F.lower("text").contains("an").alias("hit"))
    found = found.where(F.col("hit") & F.col("status").isin("1", "unclassified")).drop("hit")
    page = found.orderBy(F.desc("n_chars"), F.desc("doc_id")).offset(40).limit(20)
    return page.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


QUERIES = {"list_jobs": list_jobs}
ORACLES = {
    "list_jobs": """
WITH v AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
f AS (
    SELECT d.doc_id, d.source, d.n_chars, coalesce(CAST(v.quality AS VARCHAR), 'unclassified') AS status
    FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id WHERE contains(lower(d.text), 'an')
), g AS (SELECT * FROM f WHERE status IN ('1', 'unclassified'))
SELECT *, (SELECT count(*) FROM g) AS total FROM g ORDER BY n_chars DESC, doc_id DESC LIMIT 20 OFFSET 40
"""
}
for module in (relational, rules, scalars, texts, bodies, verdicts):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
