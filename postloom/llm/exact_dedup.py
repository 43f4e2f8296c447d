"""Exact deduplication with a log-structured merge index of digests, in DataFrame operations only.

Every input partition is a memtable: it is sorted by digest and flushed as one Parquet run, the runs of level 0. Compaction
merges the runs of a level, FANOUT at a time, into the sorted runs of the next, and keeps for each digest how many rows have
it and which row stays, until one run is left; copies collapse at the lowest level at which they meet, so no group of them
is ever in one task. The digests of several rows in the last run are hits, and a bitmap filter of bounded size is built over
them. All rows probe the filter: what it does not have is single and moves no further. What it has is verified byte for byte
(texts are grouped with their digest, after copies collapsed in each task) and looked up in the index. A digest that two
different texts share is resolved by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import attach, documents, materialize, text_of

#: Runs that are merged into one run of the next level.
FANOUT = 32
#: Bits of the filter for each hit, and at most: 2 ** 27 bits are 16 MB, which every executor gets. With more hits the filter
#: lets more single rows pass; it never keeps a hit out.
BITS_PER_HIT, MOST_BITS = 16, 1 << 27
#: Bits of one row of the filter's table.
CHUNK_BITS = 1 << 15
#: Parquet's own filters on the digest, for lookups of single digests in the runs.
FILTERED = {"parquet.bloom.filter.enabled#_digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def flush_runs(rows: DataFrame) -> DataFrame:
    """The level-0 runs: (_run, _digest, _id, _len, _sha, _row), each sorted by digest."""
    out = rows.select(F.spark_partition_id().alias("_run"), "_digest", "_id", "_len", "_sha", F.monotonically_increasing_id().alias("_row"))
    return materialize(out.sortWithinPartitions("_digest", "_id"), "digest-runs", FILTERED)


def entries(runs: DataFrame, *keys: str) -> DataFrame:
    """A row of runs as an index entry: (*keys, _n, _best), the row that stays being that of the longest text, then of the
    smallest identifier."""
    best = F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("u"), F.col("_id").alias("i"), F.col("_row").alias("r"))
    return runs.select(*keys, F.lit(1).cast("long").alias("_n"), best.alias("_best"))


def merge(level: DataFrame, *keys: str) -> DataFrame:
    """One entry for each of the keys."""
    return level.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.min("_best").alias("_best"))


def compact(runs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(_digest, _n, _keep, _keep_row): the index's last run, merged from the runs level by level."""
    level, left = entries(runs, "_run", "_digest"), 1 + (runs.agg(F.max("_run")).first()[0] or 0)
    number = 0
    while left > 1 or not number:
        number, left = number + 1, -(-left // fanout)
        merged = merge(level.withColumn("_run", F.floor(F.col("_run") / fanout).cast("int")), "_run", "_digest")
        level = materialize(merged.sortWithinPartitions("_run", "_digest"), f"digest-level-{number}", FILTERED)
    return resolved(level, "_digest")


def resolved(level: DataFrame, *keys: str) -> DataFrame:
    return level.select(*keys, "_n", F.col("_best.i").alias("_keep"), F.col("_best.r").alias("_keep_row"))


def filter_of(hits: DataFrame, bits: int) -> DataFrame:
    """(_chunk, _bits): a bitmap with a bit for each hit's digest modulo bits, in chunks; at most bits / 8 bytes."""
    place = F.pmod("_digest", F.lit(bits))
    return hits.groupBy(F.floor(place / CHUNK_BITS).cast("int").alias("_chunk")).agg(F.bitmap_construct_agg((place % CHUNK_BITS).cast("long")).alias("_bits"))


def probe(rows: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """rows with _maybe: whether the filter has the row's digest. The filter is broadcast; rows stay where they are."""
    place = F.pmod("_digest", F.lit(bits))
    at = (place % CHUNK_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    joined = rows.withColumn("_at", F.floor(place / CHUNK_BITS).cast("int")).join(F.broadcast(table), F.col("_at") == F.col("_chunk"), "left")
    return joined.withColumn("_maybe", F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))).drop("_at", "_chunk", "_bits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.xxhash64, fanout: int = FANOUT, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; null counts as empty, so all empty and blank texts are one
    group. Of a group the row with the most code points stays, then the smallest identifier; a null identifier comes last.
    Rows that repeat an identifier are rows of their own, and one row of each group is kept, whichever comes first. Other
    columns are ignored, whatever their names. An empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.select("_id", F.length("_text").alias("_len"), normalised(F.col("_text")).alias("_norm"))
    keyed = rows.withColumn("_digest", digest("_norm"))
    runs = flush_runs(keyed.withColumn("_sha", F.unhex(F.sha2("_norm", 256))))
    hits = materialize(compact(runs, fanout).where("_n > 1"), "digest-hits")
    n_hits, total = hits.count(), runs.count()
    bits = CHUNK_BITS
    while bits < BITS_PER_HIT * n_hits and bits < most_bits:
        bits *= 2
    table = materialize(filter_of(hits, bits), "digest-filter")
    probed = probe(runs, table, bits)
    seen = probe(keyed.select("_digest", "_norm"), table, bits).where("_maybe").groupBy("_digest", "_norm").agg(F.count(F.lit(1)).alias("_c"))
    clashes = materialize(seen.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_digest"), "digest-clashes")
    found = probed.where("_maybe")
    if clashes.isEmpty():
        joined = attach(found, hits, "_digest", "_n", total)
    else:  # rows of a digest that different texts share meet on their full SHA-256, which the runs carry
        plain = attach(found.join(clashes, "_digest", "left_anti"), hits.join(clashes, "_digest", "left_anti"), "_digest", "_n", total)
        clashed = found.join(clashes, "_digest", "left_semi")
        joined = plain.unionByName(attach(clashed, resolved(merge(entries(clashed, "_sha"), "_sha"), "_sha"), "_sha", "_n", total).select(plain.columns))
    single = probed.where("not _maybe").select([F.col(c) if c in probed.columns else F.lit(None).cast(t).alias(c) for c, t in joined.dtypes])
    joined = joined.unionByName(single)
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_n").isNull() | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), r AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {"op9_exact_dedup": ORACLE}
