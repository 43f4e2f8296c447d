from datetime import datetime

import pytest

from postloom.operators.migrations import Dirty, Migration, Warehouse, assign_markets, retire_legacy


def test_versions(spark, tmp_path):
    first = Migration("create", lambda t: {"jobs": spark.createDataFrame([(1, "a")], "id int, x string")}, lambda t: {})
    second = Migration("add", lambda t: {"jobs": t["jobs"].withColumn("y", t["jobs"].id + 1)}, lambda t: {"jobs": t["jobs"].drop("y")})
    w = Warehouse(spark, str(tmp_path / "w"), [first, second])
    assert w.state() == (0, False) and w.step_down() == 0
    assert w.up() == 2 and w.up() == 2 and w.tables()["jobs"].first().y == 2
    assert w.step_down() == 1 and w.tables()["jobs"].columns == ["id", "x"]

    def broken(tables):
        raise RuntimeError("broke off")

    bad = Warehouse(spark, str(tmp_path / "w"), [first, Migration("bad", broken, broken)])
    with pytest.raises(RuntimeError, match="broke off"):
        bad.up()
    assert bad.state() == (2, True)
    with pytest.raises(Dirty):
        bad.up()
    bad.force(1)
    assert w.up() == 2 and w.down() == 0
    with pytest.raises(ValueError):
        w.force(3)


def test_data_migrations(spark):
    now = datetime(2026, 1, 1)
    jobs = spark.createDataFrame([("search", "ethiojobs:1", "open", None), ("search", "x", "open", None), ("feed", "ethiojobs:1", "open", None), ("search", "ethiojobs:2", "closed", now)], "source string, source_job_id string, status string, closed_at timestamp")
    assert [(r.status, r.closed_at) for r in retire_legacy(jobs, now).collect()] == [("removed", now), ("open", None), ("open", None), ("closed", now)]
    targets = spark.createDataFrame([("feed",), ("lever",)], "ats_provider string")
    assert [r.market for r in assign_markets(targets).collect()] == ["ethiopia", "worldwide"]
