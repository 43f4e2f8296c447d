"""What several operators share: tables in the shared folder, joins on keys of very uneven size, and text expressions."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that count as white space in every contract of this package.
SPACE = r"[\x20\x09-\x0D]"
#: A group holds "a large share" from one row in this many on, so at most this many groups are large.
HEAVY_SHARE = 1000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session without the setting gets a temporary one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if master not in _own:
        _own[master] = tempfile.mkdtemp(prefix="postloom-")
        atexit.register(shutil.rmtree, _own[master], ignore_errors=True)
    return _own[master]


def give_back() -> None:
    """Return to the system what this worker process holds from work that is done."""
    from postloom.llm import textscan

    textscan.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run as a task's function whose memory goes back to the system when the task ends: workers are used again, and an
    executor's processes together must not hold what each of them once needed."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/postloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, so its lineage ends in files that outlive executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application's operators left in the shared folder. Call it once results that depend on
    them are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/postloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with groups on key. Groups of at least 1/HEAVY_SHARE of all rows, of which there are at most
    HEAVY_SHARE, are broadcast, so that their rows stay where they are; the rest is joined by a shuffle."""
    large = F.col(size) * HEAVY_SHARE >= F.lit(max(total, 1))
    heavy = F.broadcast(groups.where(large))
    hot = rows.join(heavy, key, "inner")
    cold = rows.join(F.broadcast(groups.where(large).select(key)), key, "left_anti").join(groups.where(~large), key, "left")
    return hot.unionByName(cold)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """rows with running sums over a total order, each without the row itself. No task sees more than one range of the
    order: rows are dealt by ranges, and each range adds the sums of the ranges before it."""
    keys = [f"_key{k}" for k in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order, strict=True)) | {f"_of_{c}": v for c, v in sums.items()})
    dealt = dealt.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, name)
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_of_{c}").alias(f"_sum_{c}") for c in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_add_{c}") for c in sums])
    within = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(totals), "_range")  # there are as many ranges as shuffle partitions
    out = out.withColumns({c: F.col(f"_add_{c}") + F.coalesce(F.sum(f"_of_{c}").over(within), F.lit(0)) for c in sums})
    return out.select(*rows.columns, *sums)


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
