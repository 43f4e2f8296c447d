"""Line deduplication: lines are exploded and normalised, distinct documents are counted by the hash of a line, and every
document is put together again, by position, without the lines whose hash is over the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import attach, documents, materialize, released, text_of
from postloom.session import ship

#: Frequent hashes are sent to the workers up to this many (16 bytes each); beyond, each text's own are joined to it.
BROADCAST_HASHES = 500_000


def key(line: bytes) -> bytes:
    """bytes.strip and bytes.lower know the six ASCII white-space characters and the letters A-Z only."""
    return line.strip().lower()


def line_hash(line: bytes) -> bytes | None:
    k = key(line)
    return xxhash.xxh3_128_digest(k) if k else None


def explode_lines(rows: DataFrame) -> DataFrame:
    """(text_hash, hash): the distinct hashes of the lines of each row, blank lines left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, hashes = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = {line_hash(x) for x in text.split(b"\n")} - {None}
                whole += [xxhash.xxh3_128_digest(text)] * len(found)
                hashes += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(whole, pa.binary()), pa.array(hashes, pa.binary())], ["text_hash", "hash"])

    return rows.select("text").mapInArrow(released(run), "text_hash binary, hash binary")


def rebuild(texts: list[bytes], known: list[set | frozenset], min_chars: int) -> tuple[list[bytes], list[int], list[int]]:
    """The texts without the lines in known (a set for each text), the numbers of lines and of lines dropped."""
    out, n_lines, n_dropped = [], [], []
    for text, drop in zip(texts, known, strict=True):
        lines = text.split(b"\n")
        kept = [x for x in lines if (h := line_hash(x)) is None or h not in drop or min_chars > 1 and len(key(x).decode()) < min_chars] if drop else lines
        out.append(text if len(kept) == len(lines) else b"\n".join(kept))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
    return out, n_lines, n_dropped


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """One row per input row: doc_id, text (the lines kept, joined by newlines), n_lines, n_dropped.

    A line's key is the line without white space at both ends and with A-Z in lower case. Lines whose key has at least
    min_chars (1 or more) code points and is found in at least min_docs rows are dropped from all rows; every row counts as
    a document, also one that repeats an identifier or a text. Null text counts as empty: one line, kept. A text all of whose
    lines go is empty. Keys are compared by 128-bit hashes. An empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    exploded = explode_lines(rows)
    counts = exploded.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"))  # a row gives each of its hashes once
    frequent = materialize(counts.where(F.col("docs") >= min_docs), "frequent-lines")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, text string, n_lines bigint, n_dropped bigint"

    def output(batch: pa.RecordBatch, known: list) -> pa.RecordBatch:
        texts, n_lines, n_dropped = rebuild(batch.column("text").cast(pa.binary()).to_pylist(), known, min_chars)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

    if frequent.count() <= broadcast_hashes:
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in frequent.select("hash").toLocalIterator()))
        return rows.mapInArrow(released(lambda batches: (output(x, [sent.value] * len(x)) for x in batches)), schema)

    pairs = materialize(exploded.distinct(), "text-lines")
    found = attach(pairs, frequent, "hash", "docs", pairs.count()).where("docs is not null")
    own = found.groupBy("text_hash").agg(F.collect_list("hash").alias("hashes"))
    keyed = rows.mapInArrow(lambda batches: (x.append_column("text_hash", pa.array([xxhash.xxh3_128_digest(t) for t in x.column("text").cast(pa.binary()).to_pylist()], pa.binary())) for x in batches), f"doc_id {dict(rows.dtypes)['doc_id']}, text string, text_hash binary")
    sizes = keyed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"))
    groups = materialize(own.join(sizes, "text_hash"), "text-frequent-lines")
    joined = attach(keyed, groups, "text_hash", "n", rows.count())
    return joined.select("doc_id", "text", "hashes").mapInArrow(released(lambda batches: (output(x, [set(h or ()) for h in x.column("hashes").to_pylist()]) for x in batches)), schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
    SELECT d.doc_id, u.i, u.line, regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS cut
    FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS i) u
), k AS (
    SELECT doc_id, i, line, translate(cut, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM f)) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key NOT IN (SELECT key FROM f)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {"op2_line_dedup": ORACLE}
