from datetime import datetime

from postloom.streaming import ingest as stream

COLS = "source string, ord bigint, external_id string, title string, url string, location_raw string, description string, published_at timestamp, expires_at timestamp, remote_type string, employment_type string, employer string, closed boolean, company_id bigint, target_company_id bigint"
T0 = datetime(2026, 1, 1)


def job(i, title="T", closed=False):
    return ("s", i, str(i), title, "u", "", "", None, None, "", "", "E", closed, 1, 10)


def test_batches_upsert_into_snapshots(spark, tmp_path):
    source, warehouse, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    times = iter([T0, datetime(2026, 1, 2)])
    for rows in ([job(1), job(2)], [job(1, "T2"), job(2, closed=True), job(3)]):
        spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(source)
        now = next(times)
        postings = spark.readStream.schema(COLS).parquet(source)
        stream.start(postings, warehouse, checkpoint, 40 * 86400, clock=lambda now=now: now).awaitTermination(120)
    assert stream.versions(spark, warehouse) == [0, 1]
    assert {r.source_job_id: (r.title, r.status) for r in stream.snapshot(spark, warehouse).collect()} == {"1": ("T2", "open"), "2": ("T", "closed"), "3": ("T", "open")}
    assert {r.source_job_id for r in stream.snapshot(spark, warehouse, 1).collect()} == {"1", "2"}


def test_event_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type", "value")
    out = stream.event_counts(events)
    assert out.agg({"n": "sum"}).first()[0] == events.count()
