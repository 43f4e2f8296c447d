"""Micro-batch ingestion: postings arrive as a stream of files, and each batch is upserted into the latest snapshot.

Snapshots are directories numbered by batch. A batch that is run again after a failure reads the snapshot before its own and
writes the same one, so the result does not depend on how often a batch was tried.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postloom import schema
from postloom.operators import ingest


#: Snapshots that stay.
KEEP = 5


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, warehouse: str) -> list[int]:
    """Numbers of the complete snapshots, in order."""
    root, fs = _fs(spark, warehouse)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = (re.fullmatch(r"v(\d+)", n) for n in names)
    return sorted(int(m[1]) for m in found if m and fs.exists(_fs(spark, f"{warehouse}/v{m[1]}/_SUCCESS")[0]))


def snapshot(spark: SparkSession, warehouse: str, before: int | None = None) -> DataFrame:
    """The latest snapshot, or the latest before a number; empty if there is none."""
    have = [v for v in versions(spark, warehouse) if before is None or v < before]
    if not have:
        return spark.createDataFrame([], schema.JOBS)
    return spark.read.schema(schema.JOBS).parquet(f"{warehouse}/v{have[-1]}")


def retire(spark: SparkSession, warehouse: str, number: int, keep: int) -> None:
    """Delete snapshots that are `keep` or more before this one. The one before it stays, for a batch that is run again."""
    for v in versions(spark, warehouse):
        if v <= number - max(keep, 2):
            path, fs = _fs(spark, f"{warehouse}/v{v}")
            fs.delete(path, True)


def start(postings: DataFrame, warehouse: str, checkpoint: str, stale_seconds: int, clock=datetime.now, keep: int = KEEP) -> StreamingQuery:
    """Upsert a stream of postings (schema.ATS_JOB with company_id and target_company_id); each batch is a sample of its
    targets, so postings are closed only after stale_seconds. The last `keep` snapshots stay."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        out = ingest.ingest(snapshot(spark, warehouse, number), batch, batch.select("target_company_id"), clock(), stale_seconds=stale_seconds)
        out.rows.write.mode("overwrite").parquet(f"{warehouse}/v{number}")
        batch.unpersist()
        retire(spark, warehouse, number, keep)

    return postings.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, minutes: int = 60, late_minutes: int = 120) -> DataFrame:
    """Events and summed values by type and hour; late events count until the watermark passes their window."""
    stamped = events.withWatermark("ts", f"{late_minutes} minutes")
    counts = stamped.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "value")
