"""Versions of the stored tables: migrations are functions over the tables, applied in order and recorded beside them.

Tables are directories <warehouse>/<version>/<table>; a version is recorded as dirty before it is written and as clean after,
so a migration that broke off is seen, and nothing runs until the version is forced.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Migration:
    name: str
    up: Callable[[Tables], Tables]
    down: Callable[[Tables], Tables]


class Dirty(RuntimeError):
    """A migration broke off; force a version first."""


class Warehouse:
    def __init__(self, spark: SparkSession, path: str, migrations: list[Migration]):
        self.spark, self.path, self.migrations = spark, path.rstrip("/"), migrations

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> tuple[int, bool]:
        """Version and whether it is dirty; 0 before any migration."""
        path, fs = self._file("schema.json")
        if not fs.exists(path):
            return 0, False
        found = json.loads(self.spark.read.text(str(path), wholetext=True).first()[0])
        return found["version"], found["dirty"]

    def _record(self, version: int, dirty: bool) -> None:
        path, fs = self._file("schema.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps({"version": version, "dirty": dirty}).encode()))
        out.close()

    def tables(self, version: int | None = None) -> Tables:
        root, fs = self._file(str(self.state()[0] if version is None else version))
        if not fs.exists(root):
            return {}
        return {s.getPath().getName(): self.spark.read.parquet(s.getPath().toString()) for s in fs.listStatus(root) if s.isDirectory() and not s.getPath().getName().endswith(".new")}

    def _move(self, version: int, change: Callable[[Tables], Tables]) -> None:
        old = self.tables()
        self._record(version, True)
        for name, df in change(old).items():
            df.write.mode("overwrite").parquet(f"{self.path}/{version}/{name}")
        self._record(version, False)

    def _clean(self) -> int:
        version, dirty = self.state()
        if dirty:
            raise Dirty(f"version {version} is dirty")
        return version

    def up(self) -> int:
        """Apply all migrations that are due; none is fine. The new version."""
        for version in range(self._clean() + 1, len(self.migrations) + 1):
            self._move(version, self.migrations[version - 1].up)
        return self.state()[0]

    def step_down(self) -> int:
        """Roll the last migration back; nothing to roll back is fine."""
        version = self._clean()
        if version:
            self._move(version - 1, self.migrations[version - 1].down)
        return self.state()[0]

    def down(self) -> int:
        while self.step_down():
            pass
        return 0

    def force(self, version: int) -> None:
        """Record a version as clean without running anything."""
        if not 0 <= version <= len(self.migrations):
            raise ValueError(f"there is no version {version}")
        self._record(version, False)


# The source and identifiers of rows another source took over, and the sources of the home market.
LEGACY_SOURCE, LEGACY_PREFIX = "search", "ethiojobs:"
HOME_SOURCES = ("feed", "careers-site", "search", "ethiojobs", "linkedin")


def retire_legacy(jobs: DataFrame, now: datetime) -> DataFrame:
    """Open postings under the old identifiers are removed."""
    hit = (F.col("source") == LEGACY_SOURCE) & F.col("source_job_id").startswith(LEGACY_PREFIX) & (F.col("status") == "open")
    return jobs.withColumns({"status": F.when(hit, "removed").otherwise(F.col("status")), "closed_at": F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("closed_at"))})


def assign_markets(targets: DataFrame) -> DataFrame:
    return targets.withColumn("market", F.when(F.col("ats_provider").isin(*HOME_SOURCES), "ethiopia").otherwise("worldwide"))
