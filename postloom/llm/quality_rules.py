"""Quality rules: base counts of every document, then a log-likelihood ratio of hashed n-grams.

One pass counts hashed word unigrams and bigrams of all documents (the raw corpus) and of the trusted ones (the target) in
tables of fixed size. The verdict of a document is the mean, over its n-grams, of the log ratio of the two smoothed
multinomials, held against a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import documents, materialize, released
from postloom.llm.textscan import Scan, distinct, mix, scans
from postloom.session import ship

#: Buckets of the two tables; they are collected, 16 bytes a bucket, whatever the size of the corpus.
BUCKETS = 1 << 16
#: Added to the counts of every bucket, as a share of the mean count, and the least mean log ratio of a kept document.
SMOOTHING, THRESHOLD = 0.1, -0.13
#: Trusted identifiers are broadcast up to this many (8 bytes each), and joined by a shuffle beyond.
BROADCAST_IDS = 2_000_000
#: A document fails with fewer words, or with a larger percentage of its words in repeated windows of three.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"


def buckets(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every unigram and bigram, letters A-Z in lower case."""
    words = scan.words()
    pairs, docs, _ = scan.grams(2, words)
    hashes = np.concatenate((mix(words + np.uint64(1)), mix(pairs + np.uint64(2))))
    return (hashes >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64), np.concatenate((scan.word_docs(), docs))


def base_counts(scan: Scan) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    n = scan.n_docs
    chars = ~scan.space & ((scan.data & 0xC0) != 0x80)
    starts, ends, first = scan.lines()
    inside = np.zeros(len(scan.data) + 1, np.int64)
    np.cumsum(~scan.space, out=inside[1:])
    full = np.flatnonzero(inside[ends] > inside[starts])
    line_docs = np.repeat(np.arange(n), np.diff(first))[full]
    raw = Scan.__new__(Scan)  # lines are compared as they are, in upper and lower case
    raw.data, raw.lower, raw._sums = scan.data, False, None
    line_of, _, _, _ = distinct(line_docs, raw.span_hash(starts[full], ends[full]))
    grams, docs, at = scan.grams(3, raw.span_hash(scan.starts, scan.ends))
    _, _, times, pair = distinct(docs, grams)
    twice = at[times[pair] > 1] if len(at) else at
    repeated = np.zeros(len(scan.starts) + 1, bool)
    for k in range(3):
        repeated[twice + k] = True
    sums = np.zeros(len(repeated) + 1, np.int64)
    np.cumsum(repeated, out=sums[1:])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    return {
        "n_words": scan.counts(),
        "word_chars": scan.per_doc(chars),
        "n_symbols": scan.per_doc(symbol[scan.data]),
        "n_dup_lines": np.bincount(line_docs, minlength=n) - np.bincount(line_of, minlength=n),
        "n_repeat_words": np.diff(sums[scan.first]),
    }


def count_ngrams(marked: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all rows and over those with trusted = true."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            for a, b, scan in scans(batch.column("text"), lower=True):
                found, docs = buckets(scan)
                raw += np.bincount(found, minlength=BUCKETS)
                target += np.bincount(found[trusted[a:b][docs]], minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"part": np.arange(64), "raw": list(raw.reshape(64, -1)), "target": list(target.reshape(64, -1))})

    rows = marked.select(F.col(text_col).alias("text"), "trusted").mapInArrow(released(partial), "part bigint, raw array<bigint>, target array<bigint>")
    cells = rows.select("part", F.posexplode(F.arrays_zip("raw", "target")).alias("at", "c"))
    sums = cells.groupBy("part", "at").agg(F.sum("c.raw").alias("raw"), F.sum("c.target").alias("target")).collect()  # BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for part, at, x, y in sums:
        raw[part * (BUCKETS // 64) + at], target[part * (BUCKETS // 64) + at] = x, y
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of target over raw probability by bucket; 0 everywhere if nothing is trusted."""
    if not target.sum():
        return np.zeros(len(raw))
    smooth = lambda c: np.log((c + smoothing * c.mean()) / (c.sum() * (1 + smoothing)))
    return smooth(target) - smooth(raw)


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, kept, llr (the mean log ratio).

    trusted: a table whose identifiers (id_col) mark the target's documents; identifiers may repeat or be null, which marks
    nothing. Null text counts as empty: no words, so base_failed. Without trusted documents every ratio is 0. Rows that
    repeat an identifier are judged each by its own text. An empty table gives no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    ids = materialize(trusted.select(F.col(id_col).alias("_trusted")).where("_trusted is not null").distinct(), "trusted-ids")
    side = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.join(side, F.col("doc_id") == F.col("_trusted"), "left").select("text", F.col("_trusted").isNotNull().alias("trusted"))
    ratios = spark.sparkContext.broadcast(log_ratio(*count_ngrams(marked, "text")).astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratios.value
        for batch in batches:
            for a, b, scan in scans(batch.column("text"), lower=True):
                out = base_counts(scan)
                found, docs = buckets(scan)
                n = np.bincount(docs, minlength=b - a)
                llr = np.bincount(docs, table[found], minlength=b - a) / np.maximum(n, 1)
                failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a), **{k: pa.array(v, pa.int64()) for k, v in out.items()}, "base_failed": failed, "kept": ~failed & (llr >= threshold), "llr": llr})

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(released(score), f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, llr double")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted: the documents whose label says so."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(documents(spark, sf_dir), labels.where("quality = 1"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {}
