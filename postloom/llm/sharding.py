"""Sharding by a hierarchical weighted hash tree: regions hold racks, racks hold shards.

A document descends the tree; at each level every child draws an exponential number of rate equal to its weight from the
hash of the document and the child's path, and the smallest draw wins. So a child gets documents in proportion to its
weight, and changing a weight moves documents only into or out of the subtree whose weight changes.

One family of trees serves every count of shards. While the tree's own shards last, the first of them are in service and a
document that comes to another one descends again with fresh draws; so a shard that enters service takes the documents that
come to it first, and nothing else moves. Beyond them a shard is added as a region of its own: its draw is the only new one,
so documents move into it and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.common import documents, materialize, text_of


#: Descents of a document that comes to shards out of service.
TRIES = 6


@dataclass(frozen=True)
class Tree:
    """regions[r][k] lists the weights of the shards in rack k of region r; shards are numbered in that order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    def __post_init__(self):
        if not self.regions or any(not rack or min(rack) <= 0 for region in self.regions for rack in region or ((),)):
            raise ValueError("every region has racks, every rack has shards, and every weight is above 0")

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a rack and region of its own."""
        return Tree((*self.regions, ((weight,),)))


def even_tree(n_shards: int, regions: int = 3, racks: int = 4, shards: int = 2) -> Tree:
    """The even tree of regions * racks * shards, and a region of its own for each shard that n_shards has beyond it."""
    if n_shards < 1:
        raise ValueError("there is no shard")
    tree = Tree((((1.0,) * shards,) * racks,) * regions)
    while tree.n_shards < n_shards:
        tree = tree.grown()
    return tree


def descend(key: Column, path: Column, weights: Column) -> Column:
    """The position of the winning child. A draw is exponential with the child's weight as its rate, from 52 bits of the MD5
    of the key and the child's path; weights is an array with an element for each child."""

    def draw(weight: Column, child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), path, child.cast("string"))), 1, 13), 16, 10).cast("double")
        return -F.log((bits + 1.0) / F.lit(2.0**52 + 1)) / weight

    draws = F.transform(weights, draw)
    return F.array_position(draws, F.array_min(draws)).cast("int") - 1


def with_leaf(rows: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """rows with the shard of each by its key, a string: one draw among the children of each level passed."""
    rack_weights = [[float(sum(rack)) for rack in region] for region in tree.regions]
    shard_weights = [[list(map(float, rack)) for rack in region] for region in tree.regions]
    first, number = [], 0  # of each rack's shards
    for region in tree.regions:
        first.append([])
        for rack in region:
            first[-1].append(number)
            number += len(rack)

    def literal(x) -> Column:
        return F.array(*map(literal, x)) if isinstance(x, list) else F.lit(x)

    at = lambda table, *positions: at(F.get(table, positions[0]), *positions[1:]) if positions else table
    region, rack = F.col("_region"), F.col("_rack")
    rows = rows.withColumn("_region", descend(key, F.lit("r"), literal([float(sum(w)) for w in rack_weights])))
    rows = rows.withColumn("_rack", descend(key, F.concat(region.cast("string"), F.lit(".")), at(literal(rack_weights), region)))
    leaf = descend(key, F.concat_ws(".", region, rack, F.lit("")), at(literal(shard_weights), region, rack))
    return rows.withColumn(name, at(literal(first), region, rack) + leaf).drop("_region", "_rack")


def with_shard(rows: DataFrame, key: str, tree: Tree, in_service: int, name: str) -> DataFrame:
    """rows with the shard of each by its key, a string column, of the first in_service shards of the tree.

    A document descends at most TRIES times; what found no shard in service by then goes to the one in service with the
    smallest draw of its own, which no shard that enters later changes either, but for the documents it takes."""
    if in_service >= tree.n_shards:
        return with_leaf(rows, F.col(key), tree, name)
    tries = [f"_try{k}" for k in range(TRIES)]
    for k, t in enumerate(tries):
        rows = with_leaf(rows, F.concat(F.col(key), F.lit(f"#{k}" if k else "")), tree, t)
    weights = [float(w) for region in tree.regions for rack in region for w in rack][:in_service]
    last = descend(F.col(key), F.lit("shard"), F.array(*map(F.lit, weights)))
    return rows.withColumn(name, F.coalesce(*[F.when(F.col(t) < in_service, F.col(t)) for t in tries], last)).drop(*tries)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with a number, gapless from 0 in each group, by order. Groups of any size spread over many tasks: rows are
    dealt by ranges of (group, order), each range counts its rows by group, and the counts before it are added."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    dealt = materialize(dealt.withColumn("_place", F.monotonically_increasing_id()), "numbered").withColumn("_range", F.shiftright("_place", 33))
    runs = dealt.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    runs = runs.withColumn("_add", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    # there are at most as many runs as ranges and groups together
    return dealt.join(F.broadcast(runs.select("_range", group, "_add")), ["_range", group], "inner").withColumn(name, F.col("_place") + F.col("_add")).drop("_range", "_place", "_add")


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tree: Tree | None = None) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes and 8), text_crc32, law, shard, slot, grown_shard.

    The law is "key": the identifier and the tree decide alone, so rows that repeat an identifier share a shard, also those
    with a null one, and equal texts under different identifiers need not. grown_shard is the shard with one shard more; it
    differs from shard only where it is the new one. Slots follow the identifier, then the text's checksum; rows equal in
    both are numbered in any order. Null text counts as empty. An empty table gives no rows. With a tree, its shards count.
    """
    n_shards = tree.n_shards if tree else n_shards
    tree = tree or even_tree(n_shards)
    text = text_of(text_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"))
    rows = with_shard(rows, "_key", tree, n_shards, "shard")
    rows = with_shard(rows, "_key", tree if n_shards < tree.n_shards else tree.grown(), n_shards + 1, "grown_shard").drop("_key")
    out = numbered(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


#: The draws again in SQL, and a table-driven CRC-32 over the bytes' hexadecimal digits.
ORACLE = r"""
WITH k AS (
    SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, upper(hex(encode(coalesce(text, '')))) AS x FROM documents
), bits AS (
    SELECT i, CAST(i AS BIGINT) AS c FROM range(256) r(i)
), b8 AS (
    SELECT i, list_reduce(range(8), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, c) AS c FROM bits
), tab AS (
    SELECT list(c ORDER BY i) AS t FROM b8
), crc AS (
    SELECT doc_id, key, CAST(length(x) // 2 + 8 AS BIGINT) AS size,
        xor(list_reduce(list_transform(range(length(x) // 2), lambda j: CAST((instr('0123456789ABCDEF', x[2 * j + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * j + 2]) - 1 AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
    FROM k, tab
), draws AS (
    SELECT doc_id, key, size, text_crc32, CAST(n AS INT) AS n, CAST(c AS INT) AS c,
        -ln((CAST('0x' || substr(md5(key || '|r' || c), 1, 13) AS BIGINT) + 1.0) / (4503599627370496.0 + 1)) / CASE WHEN c < 3 THEN 8.0 ELSE 1.0 END AS d
    FROM crc, (VALUES (24), (25)) m(n), range(4) r(c) WHERE c < 3 OR n = 25
), region AS (
    SELECT doc_id, key, size, text_crc32, n, arg_min(c, d) AS r FROM draws GROUP BY ALL
), rack AS (
    SELECT doc_id, key, size, text_crc32, n, r, CASE WHEN r = 3 THEN 0 ELSE
        list_position(l, list_min(l)) - 1 END AS k
    FROM (SELECT *, list_transform(range(4), lambda c: -ln((CAST('0x' || substr(md5(key || '|' || r || '.' || c), 1, 13) AS BIGINT) + 1.0) / (4503599627370496.0 + 1)) / 2.0) AS l FROM region)
), leaf AS (
    SELECT doc_id, size, text_crc32, n, CAST(CASE WHEN r = 3 THEN 24 ELSE r * 8 + k * 2 + list_position(l, list_min(l)) - 1 END AS INT) AS s
    FROM (SELECT *, list_transform(range(2), lambda c: -ln((CAST('0x' || substr(md5(key || '|' || r || '.' || k || '.' || c), 1, 13) AS BIGINT) + 1.0) / (4503599627370496.0 + 1))) AS l FROM rack)
), both_ AS (
    SELECT doc_id, size, text_crc32, max(s) FILTER (n = 24) AS shard, max(s) FILTER (n = 25) AS grown_shard FROM leaf GROUP BY ALL
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard FROM both_
"""
QUERIES = {"op8_sharding": op8_sharding}
ORACLES = {"op8_sharding": ORACLE}
