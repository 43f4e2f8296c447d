"""The Spark session and the package's way to the Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch. The default of 64 MB is held several times by the JVM, outside its heap, and by the worker, for each
#: task; the operators work on about a megabyte at a time anyway.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers of a session, once; they need no installation of their own. Arrow batches of
    the session become smaller, if it has not set their size itself."""
    key, size = ARROW_BATCH
    if spark.conf.get(key) in ("64MB", f"{64 << 20}b", str(64 << 20)):  # the default
        spark.conf.set(key, str(size))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="postloom-")) / f"{root.name}.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted([*root.rglob("*.py"), *root.rglob("*.json")]):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benches."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("postloom")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
