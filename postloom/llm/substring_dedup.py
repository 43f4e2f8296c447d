"""Substring deduplication with automata of repeated phrases.

1. Of every window of consecutive words the word 5-gram with the smallest hash is its anchor; equal windows have equal
   anchors. Anchors found under one identifier only cannot lie in a repeated window and go.
2. The other windows of a document, as pieces of text around their anchor, are dealt to shards by the anchor. Streaming every
   document through every shard would grow with the square of the corpus; a document goes, with all its text around the
   anchors, to the shards those anchors name, which loses no window.
3. In a shard the windows found under several identifiers are confirmed by their words and compiled once into an Aho-Corasick
   automaton over words, each with the smallest identifier it starts in. All text dealt to the shard is streamed through it;
   the automaton alone finds the occurrences. Anchors of very many pieces have their windows confirmed by an aggregation
   instead, and their pieces spread over shards.
4. Words of occurrences whose window starts under a smaller identifier are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import documents, materialize, released, text_of
from postloom.llm.textscan import Scan, distinct, scans
from postloom.session import ship

U = np.uint64
#: Words of a window and of an anchor.
WINDOW, ANCHOR = 13, 5
#: Pieces of a shard, about; an anchor of more pieces than HOT is confirmed and dealt apart.
SHARD, HOT = 8_000, 4_000
#: Anchors are sent to the workers up to this many (12 bytes each), documents' spans up to so many rows; joined beyond.
BROADCAST_ANCHORS, BROADCAST_SPANS = 4_000_000, 300_000
#: A null identifier comes after all others.
LAST = (1 << 63) - 1


def anchors(scan: Scan, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's hash, document, first and last window (by first word, over all
    documents)."""
    none = np.empty(0, np.int64)
    words, counts = scan.words(), scan.counts()
    n, wide = len(words), window - anchor + 1
    if n < window:
        return np.empty(0, U), none, none, none
    grams = words[: n - anchor + 1].copy()
    for k in range(1, anchor):
        grams *= U(0x9E3779B97F4A7C15)
        grams += words[k : n - anchor + 1 + k]
    grams ^= grams >> U(29)
    grams *= U(0xBF58476D1CE4E5B9)
    grams ^= grams >> U(32)
    m = n - window + 1
    least, at = grams[:m].copy(), np.zeros(m, np.int32)
    for k in range(1, wide):
        less = grams[k : m + k] < least
        least[less] = grams[k : m + k][less]
        at[less] = k
    docs = scan.word_docs()
    ok = np.flatnonzero(docs[:m] == docs[window - 1 :])
    if not len(ok):
        return np.empty(0, U), none, none, none
    place, doc = ok + at[ok], docs[ok]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))
    last = ok[np.append(new[1:], len(ok)) - 1]
    return least[ok[new]], doc[new], ok[new], last


def anchor_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, id, key, pieces): the distinct anchors of each row, and how many of its pieces have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("id", "key"))
            for a, _, scan in scans(batch.column("text")):
                h, d, _, _ = anchors(scan, window, anchor)
                d, h, times, _ = distinct(d, h)
                yield pa.RecordBatch.from_pydict({"anchor": h.view(np.int64), "id": ids[a + d], "key": keys[a + d], "pieces": times.astype(np.int32)})

    return rows.mapInArrow(released(run), "anchor bigint, id bigint, key bigint, pieces int")


def pieces(rows: DataFrame, window: int, anchor: int, known) -> DataFrame:
    """(anchor, n, id, key, first, piece) for every run of windows whose anchor is known: n is the anchor's number of pieces,
    first the place of the piece's first word, piece its words with one space between. known: a broadcast of sorted anchors
    and numbers, or None where rows have their own as an array column, found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy() for c in ("id", "key"))
            for a, b, scan in scans(batch.column("text")):
                h, d, first, last = anchors(scan, window, anchor)
                if known is None:
                    own = batch.column("found").slice(a, b - a).flatten()
                    table = np.array(own.field(0).to_numpy(zero_copy_only=False), np.int64).view(U)
                    table, at = np.unique(table, return_index=True)
                    numbers = np.array(own.field(1).to_numpy(zero_copy_only=False), np.int32)[at]
                else:
                    table, numbers = known.value
                if not len(table) or not len(h):
                    continue
                at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                hit = table[at] == h
                h, d, first, last, n = h[hit], d[hit], first[hit], last[hit], numbers[at[hit]]
                if not len(h):
                    continue
                lengths = np.concatenate(([0], np.cumsum(scan.ends - scan.starts)))
                left, right, stop = scan.starts[first], scan.ends[last + window - 1], last + window
                plain = right - left == lengths[stop] - lengths[first] + stop - first - 1
                raw = np.where(scan.space, np.uint8(32), scan.data).tobytes()
                texts = [raw[x:y] if p else b" ".join(raw[x:y].split()) for x, y, p in zip(left.tolist(), right.tolist(), plain.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(n, pa.int32()), pa.array(ids[a + d]), pa.array(keys[a + d]), pa.array((first - scan.first[d]).astype(np.int32)), pa.array(texts, pa.binary())],
                    ["anchor", "n", "id", "key", "first", "piece"],
                )

    return rows.mapInArrow(released(run), "anchor bigint, n int, id bigint, key bigint, first int, piece binary")


def windows_of(piece: bytes, window: int) -> list[bytes]:
    """The windows of a piece of words with one space between."""
    cuts = [-1, *[m.start() for m in re.finditer(b" ", piece)], len(piece)]
    return [piece[a + 1 : b] for a, b in zip(cuts, cuts[window:], strict=False)]


def compile_windows(confirmed: dict[tuple[int, ...], int]) -> ahocorasick.Automaton | None:
    """The automaton over word numbers in which every confirmed window gives its smallest identifier."""
    if not confirmed:
        return None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, smallest in confirmed.items():
        automaton.add_word(words, smallest)
    automaton.make_automaton()
    return automaton


def confirm(own: list[int], ids: list[int], texts: list[tuple[int, ...]], window: int) -> dict[tuple[int, ...], int]:
    """Windows found under several identifiers, with the smallest: those that came so (own = 0), and those of the shard's
    own pieces (own = 1)."""
    confirmed: dict[tuple[int, ...], int] = {}
    known: dict[tuple[int, ...], tuple[int, int]] = {}  # smallest and largest identifier of each piece
    for kind, doc, text in zip(own, ids, texts, strict=True):
        if kind == 0:
            confirmed[text] = doc
        elif kind == 1:
            low, high = known.get(text, (doc, doc))
            known[text] = (min(low, doc), max(high, doc))
    least: dict[tuple[int, ...], int] = {}
    for text, (low, high) in known.items():
        for k in range(len(text) - window + 1):
            w = text[k : k + window]
            before = least.setdefault(w, low)
            if before != low or low != high:
                confirmed[w] = least[w] = min(before, low)
    return confirmed


def search(own: list[int], ids: list[int], keys: list[int], firsts: list[int], pieces: list[bytes], window: int) -> tuple[list, list, list, list]:
    """Spans (id, key, from, to) of the pieces of one shard; see locate."""
    numbers: dict[bytes, int] = {}
    numbered: dict[bytes, tuple[int, ...]] = {}
    for piece in pieces:
        if piece not in numbered:
            numbered[piece] = tuple([numbers.setdefault(w, len(numbers) + 1) for w in piece.split(b" ")])
    texts = [numbered[piece] for piece in pieces]
    out: tuple[list, list, list, list] = ([], [], [], [])
    automaton = compile_windows(confirm(own, ids, texts, window))
    if automaton is None:
        return out
    hits: dict[tuple[int, ...], list[tuple[int, int]]] = {}  # of each text: words up to a window's end, and the smallest identifier
    for kind, doc, key, first, text in zip(own, ids, keys, firsts, texts, strict=True):
        if kind == 0:
            continue
        found = hits.get(text)
        if found is None:
            found = hits[text] = [(end + 1, smallest) for end, smallest in automaton.iter(text)]
        start = stop = -1
        for to, smallest in found:
            if smallest < doc:
                if to - window > stop:
                    if stop >= 0:
                        for c, v in zip(out, (doc, key, first + start, first + stop), strict=True):
                            c.append(v)
                    start = to - window
                stop = to
        if stop >= 0:
            for c, v in zip(out, (doc, key, first + start, first + stop), strict=True):
                c.append(v)
    return out


def locate(dealt: DataFrame, window: int) -> DataFrame:
    """(id, key, from, to): spans of words that a window of a smaller identifier covers. Rows (shard, own, id, key, first,
    piece) of a shard lie together: own = 0 is a confirmed window with its smallest identifier, own = 1 a piece whose windows
    are confirmed here, own = 2 a piece whose windows came confirmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def result() -> pa.RecordBatch:
            columns = [[x for part in held for x in part[c]] for c in range(5)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in search(*columns, window)], ["id", "key", "from", "to"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else []
            for a, b in zip(cuts, [*cuts[1:], len(shards)], strict=True):
                if held and shards[a] != shard:
                    yield result()
                shard = shards[a]
                held.append([batch.column(c).slice(a, b - a).to_pylist() for c in ("own", "id", "key", "first", "piece")])
        if held:
            yield result()

    return dealt.mapInArrow(released(run), "id bigint, key bigint, from bigint, to bigint")


def explode_windows(found: DataFrame, window: int) -> DataFrame:
    """(anchor, piece, lo, hi): every window of the pieces, with the pieces' smallest and largest identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [windows_of(p, window) for p in batch.column("piece").to_pylist()]
            times = [len(x) for x in lists]
            again = {c: pa.array(np.repeat(batch.column(c).to_numpy(), times), pa.int64()) for c in ("anchor", "lo", "hi")}
            yield pa.RecordBatch.from_arrays([again["anchor"], pa.array([w for x in lists for w in x], pa.binary()), again["lo"], again["hi"]], ["anchor", "piece", "lo", "hi"])

    return found.select("anchor", "piece", "lo", "hi").mapInArrow(released(run), "anchor bigint, piece binary, lo bigint, hi bigint")


def merge_spans(spans: DataFrame) -> DataFrame:
    """(id, key, spans) with spans that touch or overlap made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for found in batch.column("spans").to_pylist():
                out: list[list[int]] = []
                for a, b in sorted((s["from"], s["to"]) for s in found):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(b, out[-1][1])
                    else:
                        out.append([a, b])
                merged.append([{"from": a, "to": b} for a, b in out])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(merged, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], ["id", "key", "spans"])

    return spans.mapInArrow(released(run), "id bigint, key bigint, spans array<struct<from:bigint,to:bigint>>")


def remove_spans(rows: DataFrame, kind: str) -> DataFrame:
    """rows (doc_id, text, spans) to (doc_id, text, n_words, n_removed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.split()  # bytes: at the six ASCII white-space characters
                kept, at = [], 0
                for span in sorted((s["from"], s["to"]) for s in spans or ()):
                    kept += words[at : max(at, span[0])]
                    at = max(at, span[1])
                kept += words[at:]
                texts.append(b" ".join(kept))
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    return rows.mapInArrow(released(run), f"doc_id {kind}, text string, n_words bigint, n_removed bigint")


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, hot: int = HOT, broadcast_anchors: int = BROADCAST_ANCHORS, broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """One row per input row: doc_id, text (the words kept, one space between), n_words, n_removed.

    A word goes when a window of consecutive words that covers it also starts in a row with a smaller identifier; windows
    are judged on the input. A null identifier is larger than all others; rows with the same identifier do not remove each
    other's words. Null and blank texts have no words; texts shorter than a window keep all. An empty table gives no rows;
    other columns are ignored. Identifiers are integers.
    """
    spark = docs.sparkSession
    ship(spark)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    work = rows.select("id", "key", "text")
    counts = anchor_rows(work, window, anchor).groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("pieces").alias("n"))
    repeated = materialize(counts.where("lo < hi").select("anchor", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")), "repeated-anchors")
    number, total = repeated.agg(F.count(F.lit(1)), F.sum("n")).first()
    if number <= broadcast_anchors:
        table = repeated.toArrow()
        hashes, numbers = table["anchor"].to_numpy().view(U), table["n"].to_numpy()
        order = np.argsort(hashes)
        found = pieces(work, window, anchor, spark.sparkContext.broadcast((hashes[order], numbers[order])))
    else:
        own = anchor_rows(work, window, anchor).join(repeated, "anchor").groupBy("id", "key").agg(F.collect_set(F.struct("anchor", "n")).alias("found"))
        found = pieces(work.join(own, ["id", "key"]).select("id", "key", "text", "found"), window, anchor, None)

    any_hot = repeated.where(F.col("n") > hot).limit(1).count()
    if any_hot:  # else the pieces are read once
        found = materialize(found, "pieces")
    shards = max(1, (total or 0) // shard)
    few = found.where(F.col("n") <= hot).select((F.xxhash64("anchor") % shards).alias("shard"), F.lit(1).alias("own"), "id", "key", "first", "piece")
    parts = [few]
    if any_hot:
        many = found.where(F.col("n") > hot)
        spread = lambda salt: F.xxhash64("anchor", salt) % F.lit(shards)
        salts = F.ceil(F.col("n") / hot).cast("int")
        # pieces that stand alike in many documents are one before their windows are looked at
        alike = many.groupBy("anchor", "piece").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        confirmed = explode_windows(alike, window).groupBy("anchor", "piece").agg(F.min("lo").alias("id"), F.max("hi").alias("hi")).where("id < hi")
        confirmed = materialize(confirmed.select("anchor", "id", "piece"), "confirmed-windows").join(repeated.where(F.col("n") > hot), "anchor")
        confirmed = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        parts.append(confirmed.select(spread(F.col("salt")).alias("shard"), F.lit(0).alias("own"), "id", F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("first"), "piece"))
        parts.append(many.select(spread(F.pmod(F.xxhash64("id", "key", "first"), salts).cast("int")).alias("shard"), F.lit(2).alias("own"), "id", "key", "first", "piece"))
    dealt = parts[0]
    for part in parts[1:]:
        dealt = dealt.unionByName(part)
    dealt = dealt.repartition(F.col("shard")).sortWithinPartitions("shard", "own")
    spans = locate(dealt, window).groupBy("id", "key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    spans = materialize(merge_spans(spans), "repeated-spans")
    side = F.broadcast(spans) if spans.count() <= broadcast_spans else spans
    return remove_spans(rows.join(side, ["id", "key"], "left").select("doc_id", "text", "spans"), dict(rows.dtypes)["doc_id"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
    SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)
), first_ AS (
    SELECT g, min(doc_id) AS lo FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN first_ USING (g) WHERE lo < doc_id
), k AS (
    SELECT t.doc_id, count(*) AS n_words, count(gone.i) AS n_removed, coalesce(string_agg(u.word, ' ' ORDER BY u.i) FILTER (gone.i IS NULL), '') AS kept
    FROM t, LATERAL (SELECT unnest(t.w) AS word, generate_subscripts(t.w, 1) AS i) u LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.i = u.i GROUP BY t.doc_id
)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES = {"op6_substring_dedup": ORACLE}
