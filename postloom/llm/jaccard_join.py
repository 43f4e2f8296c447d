"""Near-duplicate classes by the Jaccard similarity of word shingles, with a token-group matrix.

1. Documents with equal shingle sets are one class; everything after works on classes.
2. Under one global order of shingles, in which those known to be frequent come last, two sets that are similar enough share
   a shingle of their prefixes. Each shingle found in several prefixes has a central member, the one with the fewest rarer
   shingles; it is compared with the other members. What is linked so far forms groups of similar classes.
3. The matrix holds each group's token union: a row for every shingle and group that has it in a member's prefix. For a query
   (a class) and a group, the query's tokens in the group's union are counted; what two sets can share is at most that count
   and what lies behind the prefix of one of them. Only groups that the bound lets reach the similarity, with a member size
   that fits, are opened: in the lists of the shared shingles the query is held against the group's members by parity
   bitmaps, which bound the overlap from above, in blocks of bounded size. Shingles with very many groups give no rows of
   the count; they count as shared with every group, and their lists are opened whole.
4. Pairs that pass are compared exactly; links become components.

Every pair that is similar enough is linked in step 2 or 3, or is in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.common import attach, documents, materialize, released, text_of
from postloom.llm.components import connected_components
from postloom.llm.textscan import Scan, mix, scans
from postloom.session import ship

U = np.uint64
#: One document in SAMPLE is looked at for frequent shingles, of which at most FREQUENT are kept. They only order shingles.
SAMPLE, FREQUENT = 16, 50_000
#: Members of a shingle's list that are held against each other at once; longer lists are dealt to pairs of such blocks.
BLOCK = 1024
#: A shingle of more groups than FEW is busy: its groups are not paired with its members by rows.
FEW = 64
#: A list that should have more members than this, by the sample, is split by salts before it is aggregated.
SPLIT = 50_000
#: Identifiers of classes to compare are broadcast up to this many (24 bytes each), and joined by a shuffle beyond.
BROADCAST_CLASSES = 1_000_000


def shingle_sets(scan: Scan, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each document's word n-grams; with fewer words, of its whole sequence."""
    words, counts = scan.words(), scan.counts()
    grams, docs, _ = scan.grams(n, words)
    cuts = np.searchsorted(docs, np.arange(scan.n_docs + 1)).tolist()
    out = []
    for i in range(scan.n_docs):
        x = grams[cuts[i] : cuts[i + 1]]
        if len(x) > 1:
            x = np.sort(x)
            x = x[np.append(True, x[1:] != x[:-1])]
        out.append(x)
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            h, d, _ = scan.grams(k, words)
            whole = mix(h + U(k))
            at = np.searchsorted(d, short)
            for i, j in zip(short.tolist(), at.tolist(), strict=True):
                out[i] = whole[j : j + 1]
    return out


def least_overlap(size_sum, percent: int):
    """The smallest intersection of two sets with so many elements together whose similarity is at least percent / 100."""
    return -(-percent * size_sum // (100 + percent))


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of the hashes by bucket: two buckets at least for an element, a power of two of them. The low bits of a
    bucket's number come first, so halves of a bitmap fold into the smaller one by exclusive or."""
    bits = 256
    while bits < 2 * len(hashes) and bits < 1 << 16:
        bits *= 2
    parity = np.bincount((hashes & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def class_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit digests of the sets, as pairs of signed 64-bit numbers."""
    return np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)


def describe(rows: DataFrame, n: int) -> DataFrame:
    """rows (doc_id, text_key, text) to (doc_id, text_key, size, d1, d2, bits)."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, scan in scans(batch.column("text"), lower=True):
                sets = shingle_sets(scan, n)
                keys = class_keys(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("text_key").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([bitmap(s) for s in sets], pa.binary())],
                    ["doc_id", "text_key", "size", "d1", "d2", "bits"],
                )

    return rows.mapInArrow(released(run), f"doc_id {kind}, text_key bigint, size bigint, d1 bigint, d2 bigint, bits binary")


def frequent_shingles(rows: DataFrame, n: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found more than once in a sample of the documents, at most `most`: sorted hashes and their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, scan in scans(batch.column("text"), lower=True):
                hashes, times = np.unique(np.concatenate([*shingle_sets(scan, n), np.empty(0, U)]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"shingle": hashes.view(np.int64), "n": times.astype(np.int64)})

    parts = rows.where(F.pmod("text_key", F.lit(sample)) == 0).select("text").mapInArrow(released(run), "shingle bigint, n bigint")
    counts = materialize(parts.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1"), "sampled-shingles")
    left, least = most, None
    for times, shingles in sorted(counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().collect(), reverse=True):  # at most 10,000 rows
        if shingles > left:
            break
        left, least = left - shingles, times
    if least is None:
        return np.empty(0, U), np.empty(0, np.int64)
    found = counts.where(F.col("n") >= least).toArrow()
    hashes, times = found["shingle"].to_numpy().view(U), found["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], times[order]


def prefixes(rows: DataFrame, n: int, percent: int, frequent, clashes, split: int) -> DataFrame:
    """(shingle, salt, node, size, place): each class's prefix under the global order. frequent and clashes are broadcasts;
    split is the number of members in the sample for each salt of a shingle. The salt is 0 but for shingles that have
    several, where it is from 1 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, times), other = frequent.value, clashes.value
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, scan in scans(batch.column("text"), lower=True):
                sets = shingle_sets(scan, n)
                keys = class_keys(sets)
                out, salts, nodes, sizes, places = [], [], [], [], []
                for s, (d1, d2) in zip(sets, keys.tolist(), strict=True):
                    if not len(s) or (d1, d2) in seen:
                        continue
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add((d1, d2))  # copies in one partition give their prefix once
                    size = len(s)
                    k = size - least_overlap_of_one(size, percent) + 1
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        is_frequent = known[at] == s
                        if is_frequent.any():
                            late, count = s[is_frequent], times[at[is_frequent]]
                            s = np.concatenate((s[~is_frequent], late[np.lexsort((late, count))]))
                    s, node = s[:k], d2 if d1 in other else d1
                    out.append(s)
                    nodes.append(node)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        lists = np.where(known[at] == s, times[at] // split, 0)  # this many more than one
                        salts.append(np.where(lists > 0, 1 + node % (lists + 1), 0).astype(np.int32))
                    else:
                        salts.append(np.zeros(k, np.int32))
                    sizes.append(size)
                    places.append(k)
                if out:
                    yield pa.RecordBatch.from_pydict({
                        "shingle": np.concatenate(out).view(np.int64), "salt": np.concatenate(salts), "node": np.repeat(np.array(nodes, np.int64), places),
                        "size": np.repeat(np.array(sizes, np.int32), places), "place": np.concatenate([np.arange(k, dtype=np.int32) for k in places]),
                    })

    return rows.select("text").mapInArrow(released(run), "shingle bigint, salt int, node bigint, size int, place int")


def least_overlap_of_one(size: int, percent: int) -> int:
    """What a set of this size shares with any set that is similar enough, at least."""
    return -(-percent * size // 100)


def may_reach(size1: Column, place1: Column, size2: Column, place2: Column, percent: int) -> Column:
    """Whether two sets of these sizes can be similar enough if they share nothing before these places. A pair that is
    similar enough passes at the first shingle the two share, which both prefixes have."""
    size1, size2 = size1.cast("long"), size2.cast("long")
    left = F.least(size1 - place1, size2 - place2)
    return (size1 * 100 >= size2 * percent) & (size2 * 100 >= size1 * percent) & (left * (100 + percent) >= (size1 + size2) * percent)


def token_groups(labelled: DataFrame) -> DataFrame:
    """The matrix: (shingle, grp) with the smallest and largest size of the group's members that have the shingle in their
    prefix, and their number, from labelled (shingle, node, size, grp)."""
    return labelled.groupBy("shingle", "grp").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n"))


def within_reach(count: Column, size: Column, least: Column, most: Column, percent: int) -> Column:
    """Whether a set of this size can be similar enough to one whose size is between least and most, if at most count
    shingles are in both prefixes: what else they share lies behind the prefix of one of them, so it is less than percent of
    the larger size, while they need percent / (100 + percent) of both sizes. That need is concave in the other's size, so
    the ends of the admissible sizes decide."""
    count, size = count.cast("long"), size.cast("long")

    def enough(other: Column) -> Column:
        need = (size + other) * 100 * percent - F.greatest(size, other) * percent * (100 + percent)
        return count * 100 * (100 + percent) >= need

    low, high = F.greatest(least, F.ceil(size * percent / 100)), F.least(most, F.floor(size * 100 / percent))
    return (low <= high) & (enough(low) | enough(high))


def opened_lists(labelled: DataFrame, matrix: DataFrame, percent: int, few: int) -> DataFrame:
    """(shingle, node): the members of shingles' lists that have to be held against each other. A query and a group of
    another label that meet in shingles of at most few groups are there if the group is within the query's reach; of a busy
    shingle all members whose size fits are."""
    meet = matrix.groupBy("shingle").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("members"), F.min("least").alias("least"), F.max("most").alias("most")).where("groups > 1")
    meet = materialize(meet, "meeting-shingles")
    busy = meet.where(F.col("groups") > few)
    size = F.col("size").cast("long")
    fits = (F.col("most").cast("long") * 100 >= size * percent) & (size * 100 >= F.col("least").cast("long") * percent)
    all_of_busy = labelled.join(busy, "shingle").where(fits).select("shingle", "node")
    shared = matrix.join(meet.where(F.col("groups") <= few).select("shingle", "members"), "shingle").select("shingle", F.col("grp").alias("other"), "least", "most", "members")
    met = labelled.join(shared, "shingle").where((F.col("grp") != F.col("other")) & fits).select("shingle", "node", "size", "other", "least", "most", "members")
    met = materialize(met, "queries-and-groups")
    counts = met.groupBy("node", "other").agg(F.count(F.lit(1)).alias("own"), F.first("size").alias("size"), F.min("least").alias("least"), F.max("most").alias("most"))
    if busy.limit(1).count():
        everywhere = labelled.join(busy.select("shingle"), "shingle", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("busy"))
        counts = counts.join(everywhere, "node", "left")
        count = F.col("own") + F.coalesce("busy", F.lit(0))
    else:
        count = F.col("own")
    reached = counts.where(within_reach(count, F.col("size"), F.col("least"), F.col("most"), percent)).select("node", "other")
    opened = materialize(met.where("members > 2").select("shingle", "node", "other").join(reached, ["node", "other"], "left_semi"), "opened-groups")
    there = opened.select("shingle", F.col("other").alias("grp")).distinct()
    members = labelled.join(there, ["shingle", "grp"], "left_semi").select("shingle", "node")
    return opened.select("shingle", "node").unionByName(members).distinct().unionByName(all_of_busy)


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose parity bitmaps allow the similarity."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(f"bits_{x}").to_pylist() for x in "ab")
            m, n = (batch.column(f"size_{x}").to_numpy() for x in "ab")
            apart = np.array([differing(x, y) for x, y in zip(a, b, strict=True)], np.int64)
            keep = (m + n - apart) // 2 >= least_overlap(m + n, percent)
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(keep)) for x in "ab"], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(released(run), "a bigint, b bigint")


def differing(x: bytes, y: bytes) -> int:
    """Buckets whose parities differ: at most the size of the symmetric difference."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = fold(np.frombuffer(x, np.uint8)).tobytes()
    return (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()


def fold(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def open_groups(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups from lists (list, part, shingle's members with side, node, size, grp, bits).

    Rows of one (list, part) lie together; a pair is formed between sides 0 and 1, or within side 2."""

    def pairs_of(side, node, size, grp, bits) -> tuple[np.ndarray, np.ndarray]:
        found_a, found_b = [], []
        widths = np.array([len(x) for x in bits])
        kinds = np.unique(widths)
        by = {w: (at := np.flatnonzero(widths == w), np.frombuffer(b"".join(bits[i] for i in at), np.uint8).reshape(len(at), w)) for w in kinds.tolist()}
        for w in by:
            for v in (w, 2 * w):
                if v not in by:
                    continue
                (at_x, x), (at_y, y) = by[w], by[v]
                y = y if v == w else fold(y)
                for k in range(0, len(at_x), max(1, (1 << 22) // max(1, y.size))):
                    rows = slice(k, k + max(1, (1 << 22) // max(1, y.size)))
                    i, j = at_x[rows][:, None], at_y[None, :]
                    ok = (grp[i] != grp[j]) & (size[i] * 100 >= size[j] * percent) & (size[j] * 100 >= size[i] * percent)
                    ok &= (side[i] + side[j] == 1) | ((side[i] == 2) & ((i < j) if v == w else True))
                    p, q = np.nonzero(ok)
                    if len(p):
                        apart = np.bitwise_count(x[rows][p] ^ y[q]).sum(1, dtype=np.int64) if len(p) * w <= 1 << 24 else np.concatenate([np.bitwise_count(x[rows][p[c : c + 4096]] ^ y[q[c : c + 4096]]).sum(1, dtype=np.int64) for c in range(0, len(p), 4096)])
                        p, q = at_x[rows][p], at_y[q]
                        keep = (size[p] + size[q] - apart) // 2 >= least_overlap(size[p] + size[q], percent)
                        found_a.append(node[p[keep]])
                        found_b.append(node[q[keep]])
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
            shingle, part = (table.column(c).to_numpy() for c in ("shingle", "part"))
            side, node, size, grp = (table.column(c).to_numpy() for c in ("side", "node", "size", "grp"))
            bits = table.column("bits").to_pylist()
            cuts = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (part[1:] != part[:-1])))
            seen: set = set()
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(shingle)).tolist(), strict=True):
                key = node[a:b].tobytes()  # shingles that stand side by side in copies have one list
                if b - a < 2 or key in seen:
                    continue
                seen.add(key)
                x, y = pairs_of(side[a:b], node[a:b], size[a:b], grp[a:b], bits[a:b])
                if len(x):
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})

        for batch in batches:  # all but the last list of what has come is complete
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < 20_000 and len(held) < 64:
                continue
            table = pa.Table.from_batches(held)
            last_s, last_p = table.column("shingle")[-1].as_py(), table.column("part")[-1].as_py()
            whole = int(np.argmax((table.column("shingle").to_numpy() == last_s) & (table.column("part").to_numpy() == last_p)))
            if whole:
                yield from compare(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held))

    return lists.mapInArrow(released(run), "a bigint, b bigint")


def compare_texts(pairs: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int, broadcast_classes: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, from the text of one document of each class."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(classes.join(nodes, "node").select("node", F.col("rep.id").alias("_id"), F.col("rep.key").alias("_key")), "classes-to-compare")
    side = F.broadcast(wanted) if wanted.count() <= broadcast_classes else wanted
    texts = rows.join(side, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.text_key == F.col("_key")), "inner").select("node", "text")
    texts = materialize(texts, "texts-to-compare")
    if texts.groupBy("node").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["node"])  # rows that repeat an identifier and a text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 128):
                part = batch.slice(k, 128)
                sets = [[s for _, _, scan in scans(part.column(x), lower=True) for s in shingle_sets(scan, n)] for x in ("text_a", "text_b")]
                keep = [100 * (c := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - c) and c > 0 for x, y in zip(*sets, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(x).filter(pa.array(keep)) for x in "ab"], ["a", "b"])

    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(released(run), "a bigint, b bigint")


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, frequent: int = FREQUENT, block: int = BLOCK, few: int = FEW, split: int = SPLIT, broadcast_classes: int = BROADCAST_CLASSES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_size (rows with an equal set), component_id.

    A set holds the distinct n-word shingles of the text with A-Z in lower case; with fewer words, the whole sequence. Two
    rows link when 100 * intersection >= percent * union; component_id is the smallest identifier reachable by links, itself
    included. Texts that are null or have no words have an empty set and link with nothing. Rows that repeat an identifier
    are rows of their own; a null identifier is never the smallest unless all of the component are null. An empty table
    gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    known = spark.sparkContext.broadcast(frequent_shingles(rows, n, sample, frequent))
    described = materialize(describe(rows, n), "shingle-sets")
    nonempty = described.where("size > 0")
    clash = nonempty.groupBy("d1").agg(F.min("d2").alias("x"), F.max("d2").alias("y")).where("x <> y").select("d1")
    clashes = spark.sparkContext.broadcast({r[0] for r in clash.collect()})  # 64-bit keys of different sets: hardly ever any
    node = F.when(F.col("d1").isin(list(clashes.value)), F.col("d2")).otherwise(F.col("d1")) if clashes.value else F.col("d1")
    described = described.withColumn("node", F.when(F.col("size") > 0, node))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("text_key").alias("key")))
    classes = described.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), rep.alias("rep"), F.count(F.lit(1)).alias("class_size"))
    classes = materialize(classes, "classes")

    tokens = prefixes(rows, n, percent, known, clashes, max(1, split // sample)).repartition(F.col("shingle"), F.col("salt"))
    one_list = Window.partitionBy("shingle", "salt")  # at most some SPLIT members
    seen = tokens.withColumns({"c": F.min(F.struct("place", "node", "size")).over(one_list), "lo": F.min("node").over(one_list), "hi": F.max("node").over(one_list)})
    members = materialize(seen.where("lo <> hi or salt > 0").drop("lo", "hi"), "shared-shingles")

    lists = members.select("shingle", "node", "size", "place", "c")
    # the centres of a list that was split, a few for each of its salts, are compared with the first of them
    centres = members.where("salt > 0").select("shingle", "c").distinct()
    tops = centres.groupBy("shingle").agg(F.min("c").alias("top"))
    centres = centres.join(F.broadcast(tops), "shingle").select("shingle", F.col("c.node").alias("node"), F.col("c.size").alias("size"), F.col("c.place").alias("place"), F.col("top").alias("c"))
    star = lists.unionByName(centres).where(F.col("node") != F.col("c.node")).where(may_reach(F.col("size"), F.col("place"), F.col("c.size"), F.col("c.place"), percent))
    star = star.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
    first = materialize(compare_texts(materialize(bounded(star, classes, percent), "star-pairs"), rows, classes, n, percent, broadcast_classes), "star-links")
    groups = materialize(connected_components(first), "groups")

    labelled = members.join(groups, "node", "left").select("shingle", "node", "size", "place", F.coalesce("component", "node").alias("grp")).distinct()
    labelled = materialize(labelled, "labelled-members")
    matrix = materialize(token_groups(labelled), "token-groups")
    opened = materialize(opened_lists(labelled, matrix, percent, few), "opened-lists")
    long_lists = opened.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"))
    queries = labelled.select("shingle", "node", "size", "grp").join(opened, ["shingle", "node"]).join(long_lists, "shingle")
    queries = queries.join(classes.select("node", "bits"), "node")
    # a list longer than a block is dealt to all pairs of its blocks
    blocks = F.ceil(F.col("members") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    queries = queries.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))
    dealt = queries.select("shingle", (low * F.col("blocks") + high).cast("bigint").alias("part"), side.cast("int").alias("side"), "node", F.col("size").cast("bigint").alias("size"), "grp", "bits")
    dealt = dealt.repartition(F.col("shingle"), F.col("part")).sortWithinPartitions("shingle", "part", "node")
    found = open_groups(dealt, percent).distinct()
    opened = materialize(found.join(star, ["a", "b"], "left_anti"), "opened-pairs")
    second = compare_texts(opened, rows, classes, n, percent, broadcast_classes)
    links = first.unionByName(materialize(second, "opened-links"))

    found = connected_components(links).withColumnRenamed("component", "grp")
    classes = classes.join(found, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    least = classes.groupBy("grp").agg(F.min("rep.id").alias("component_id"))
    named = materialize(classes.join(least, "grp").select("node", "class_size", "component_id"), "named-classes")
    filled, empty = described.where("size > 0").select("doc_id", "node", "size"), described.where("size = 0")
    out = attach(filled, named, "node", "class_size", filled.count())
    out = out.select("doc_id", F.col("size").alias("n_shingles"), "class_size", "component_id")
    return out.unionByName(empty.select("doc_id", F.col("size").alias("n_shingles"), F.lit(1).cast("bigint").alias("class_size"), F.col("doc_id").alias("component_id")))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
    SELECT a AS doc_id, a AS other FROM links
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), component AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN component USING (doc_id)
"""
QUERIES = {"op1_jaccard_join": op1_jaccard_join}
ORACLES = {"op1_jaccard_join": ORACLE}
