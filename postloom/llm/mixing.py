"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Each source takes whole passes over its documents and, for the rest of its target, the documents whose hash lies under a
threshold. The threshold comes from sums of sizes by source and hash bucket: the bucket in which the running sum crosses the
budget is split again by the next bits of the hash, until it holds one hash, and no row is ever sorted. As the hash of a
document does not change, a larger budget takes every document of a smaller one. Rows equal in identifier and text share
a hash; where the threshold falls among them, as many of them as it takes are taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.common import documents, materialize, running, text_of

#: Bits of the hash, and bits by which a boundary bucket is split at each level.
HASH_BITS, LEVEL_BITS = 60, 10
#: Tables with a row for each source are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_SOURCES = 100_000


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def targets(sources: DataFrame, weights: tuple[int, ...], budget: float, max_epochs: int) -> DataFrame:
    """(_source, source_size) with target: weights repeat over the sources by code point, null last, and share budget times
    all sizes; what a target is above max_epochs times its source is shared again by weight (water filling: sources are
    filled in the order of size by weight, in one pass over a row for each source)."""
    sources = running(sources, [F.col("_source").isNull(), F.col("_source")], {"_place": F.lit(1)}, "mix-places")
    place = F.col("_place") % len(weights)
    weight = reduce(lambda c, k: c.when(place == k, F.lit(weights[k])), range(1, len(weights)), F.when(place == 0, F.lit(weights[0])))
    s = sources.withColumn("_w", weight.cast("long")).withColumn("_cap", (F.col("source_size") * max_epochs).cast("long"))
    s = running(s, [F.col("_cap") / F.col("_w"), F.col("_source").isNull(), F.col("_source")], {"_cap0": F.col("_cap"), "_w0": F.col("_w")}, "mix-fill")
    everything, weighed = (x or 0 for x in s.agg(F.sum("source_size"), F.sum("_w")).first())
    # the level at which this source would fill if those before it are full; full itself when its cap is not above that
    level = (F.lit(everything) * F.lit(budget) - F.col("_cap0")) / (F.lit(weighed) - F.col("_w0"))
    s = materialize(s.withColumn("_full", F.col("_cap") <= F.col("_w") * level), "mix-levels")
    full_cap, full_w = (x or 0 for x in s.where("_full").agg(F.sum("_cap"), F.sum("_w")).first())
    share = (F.lit(everything) * F.lit(budget) - full_cap) * F.col("_w") / (weighed - full_w) if weighed > full_w else F.lit(None)
    return s.withColumn("target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share)).select("_source", "source_size", "target")


def thresholds(sized: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """plan with _under: the documents of the source with a hash below it take one more pass, and with _tie and _cut: so do
    those with the hash _tie whose number in the table is at most _cut.

    A document is under the threshold when the middle of its size, on the running sum by hash, is not above what is left.
    """
    state = plan.select("_source", F.col("_rest"), F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_sum"))
    done = None
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        prefix = F.shiftright("_hash", shift + LEVEL_BITS)
        open_rows = sized.withColumn("_prefix", prefix).join(small(state.withColumnRenamed("_source", "_s"), n_sources), F.col("_source").eqNullSafe(F.col("_s")) & (sized._hash.isNotNull()) & (prefix == state._prefix), "inner").select("_source", "_rest", "_sum", "size", "_hash")
        cells = open_rows.groupBy("_source", F.shiftright("_hash", shift).alias("_bucket")).agg(F.first("_rest").alias("_rest"), F.first("_sum").alias("_sum"), F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_n"), F.min("_hash").alias("_lo"), F.max("_hash").alias("_hi"))
        run = Window.partitionBy("_source").orderBy("_bucket")  # at most 2 ** LEVEL_BITS cells a source
        cells = cells.withColumn("_to", F.col("_sum") + F.sum("_size").over(run)).where("_to > _rest")
        edge = cells.withColumn("_k", F.row_number().over(run)).where("_k = 1").withColumn("_sum", F.col("_to") - F.col("_size"))
        edge = materialize(edge.select("_source", "_rest", "_bucket", "_sum", "_size", "_n", "_lo", "_hi"), "mix-edges")
        # rows of one hash are copies of one size, so the nearest to what is left is a number of them
        take = F.floor((F.col("_rest") - F.col("_sum")) * F.col("_n") / F.greatest("_size", F.lit(1)) + 0.5)
        single = edge.where("_lo = _hi").withColumn("_take", F.least(take, F.col("_n")).cast("long"))
        split = (F.col("_take") > 0) & (F.col("_take") < F.col("_n"))
        single = single.select("_source", F.when(F.col("_take") == F.col("_n"), F.col("_lo") + 1).otherwise(F.col("_lo")).alias("_under"), F.when(split, F.col("_lo")).alias("_tie"), "_take")
        done = single if done is None else done.unionByName(single)
        state = edge.where("_lo < _hi").select("_source", "_rest", F.col("_bucket").alias("_prefix"), "_sum")
        if state.isEmpty():
            break
    # a source without an edge has its running sum at or under what is left everywhere: all of it is taken
    done = done.withColumnRenamed("_source", "_s")
    ties = done.where("_tie is not null")
    if ties.isEmpty():
        done = done.withColumn("_cut", F.lit(-1).cast("long"))
    else:
        done = done.join(small(cuts(sized, ties, n_sources), n_sources), F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
    return plan.join(small(done, n_sources), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")


def cuts(sized: DataFrame, ties: DataFrame, n_sources: int) -> DataFrame:
    """(_t, _cut): of each source's rows with the hash _tie, the number of the last that is taken. Rows are counted by the
    part of the table they lie in, and numbered only within the part where the count is reached."""
    rows = sized.join(small(ties, n_sources), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_hash") == F.col("_tie")), "inner").select("_s", "_take", "_row", F.shiftright("_row", 33).alias("_part"))
    upto = Window.partitionBy("_s").orderBy("_part")
    parts = rows.groupBy("_s", "_part").agg(F.first("_take").alias("_take"), F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_to", F.sum("_n").over(upto)).where("_to >= _take and _to - _n < _take").select(F.col("_s").alias("_t"), F.col("_part").alias("_p"), (F.col("_take") - F.col("_to") + F.col("_n")).alias("_nth"))
    found = rows.join(small(parts, n_sources), F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_part") == F.col("_p")), "inner")
    found = found.withColumn("_k", F.row_number().over(Window.partitionBy("_s", "_part").orderBy("_row"))).where("_k = _nth")
    return materialize(found.select("_t", F.col("_row").alias("_cut")), "mix-cuts")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.0, max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """One row per input row: doc_id, source, size (words), source_size, target, copies, taken = size * copies.

    Null text has no words; a null source is a source of its own, the last; rows with the same identifier and text have one
    hash, and where the threshold falls among them as many are taken as come nearest to the target. A document has at most
    max_epochs copies. Documents without words take the copies of their source's hash threshold too. An empty table gives no
    rows; a table without words has targets of 0. Other columns are ignored.
    """
    text = text_of(text_col)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    hashed = F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")
    sized = materialize(docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), hashed.alias("_hash"), F.monotonically_increasing_id().alias("_row")), "mix-sizes")
    sources = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    plan = targets(sources, weights, budget, max_epochs)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("int")
    plan = materialize(plan.withColumn("_passes", passes).withColumn("_rest", F.when(F.col("_passes") < max_epochs, F.col("target") - F.col("_passes") * F.col("source_size")).otherwise(0.0)), "mix-plan")
    n = plan.count()
    plan = thresholds(sized, plan, n)
    joined = sized.join(small(plan.withColumnRenamed("_source", "_s"), n), F.col("_source").eqNullSafe(F.col("_s")), "left")
    under = F.col("_under").isNull() | (F.col("_hash") < F.col("_under")) | F.coalesce((F.col("_hash") == F.col("_tie")) & (F.col("_row") <= F.col("_cut")), F.lit(False))
    more = F.when(F.col("_rest") > 0, under.cast("int")).otherwise(0)
    copies = F.col("_passes") + more
    return joined.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15)) AS BIGINT) AS h FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source
), rounds AS (  -- in each round the sources whose share is above their cap are fixed at it
    SELECT 0 AS k, source, source_size, cap, w, false AS full_, (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) AS total FROM s
    UNION ALL
    SELECT k + 1, source, source_size, cap, w,
        full_ OR cap <= (total - coalesce(sum(CASE WHEN full_ THEN cap END) OVER (), 0)) * w / (sum(CASE WHEN NOT full_ THEN w END) OVER ()), total
    FROM rounds WHERE k < 100
), last AS (
    SELECT source, source_size, CASE WHEN full_ THEN CAST(cap AS DOUBLE)
        ELSE (total - coalesce(CAST(sum(CASE WHEN full_ THEN cap END) OVER () AS BIGINT), 0)) * w / CAST(sum(CASE WHEN NOT full_ THEN w END) OVER () AS BIGINT) END AS target FROM rounds WHERE k = 100
), p AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS BIGINT) ELSE 0 END AS passes FROM last
), r AS (
    SELECT *, CASE WHEN passes < 3 THEN target - passes * source_size ELSE 0 END AS rest FROM p
), c AS (
    SELECT d.doc_id, d.size, r.source_size, r.target, r.passes, r.rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(d.size) OVER (PARTITION BY d.source, h) AS own
    FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN rest > 0 AND 2 * (upto - own) + own <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
QUERIES = {"op10_mixing": op10_mixing}
ORACLES = {"op10_mixing": ORACLE}
