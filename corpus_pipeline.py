"""A training-corpus pipeline over the documents table, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import materialize
from postloom.llm.exact_dedup import exact_dedup
from postloom.llm.jaccard_join import jaccard_classes
from postloom.llm.mixing import mix
from postloom.llm.packing import digests, pack
from postloom.llm.quality_model import score_quality, train

#: Decisions on identifiers are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column that tells its rows apart: doc_id, unless it repeats or is null; then a number given to each row."""
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not unclear:
        return docs, "doc_id"
    row = fresh(docs, "row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-docs"), row


def joined(docs: DataFrame, decided: DataFrame, key: str, how: str) -> DataFrame:
    """docs joined with decided, whose first column has an identifier at most once; no name is in both."""
    decided = materialize(decided, "decisions")
    side = F.broadcast(decided) if decided.count() <= BROADCAST_IDS else decided
    return docs.join(side, docs[key] == decided[decided.columns[0]], how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels of the documents it is given."""
    rows, key = identified(docs)
    scores = score_quality(rows, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), id_col=key)
    return joined(rows, scores.where("predicted = 1").select(F.col("doc_id").alias(fresh(rows, "id"))), key, "left_semi").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the longest and then the one with the smallest identifier."""
    rows, key = identified(docs)
    kept = exact_dedup(rows, id_col=key).where("kept").select(F.col("doc_id").alias(fresh(rows, "id")))
    return joined(rows, kept, key, "left_semi").select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest identifier."""
    rows, key = identified(docs)
    kept = jaccard_classes(rows, id_col=key).where("doc_id = component_id").select(F.col("doc_id").alias(fresh(rows, "id")))
    return joined(rows, kept, key, "left_semi").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    rows, key = identified(docs)
    ident, times = fresh(rows, "id"), fresh(rows, "copies")
    copies = mix(rows, id_col=key).where("copies > 0").select(F.col("doc_id").alias(ident), F.col("copies").alias(times))
    taken = joined(rows, copies, key, "inner")
    return taken.withColumn(fresh(taken, "copy"), F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with checksums in place of the ids. Copies of a document have row_ids of their own."""
    return digests(pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixture),
    ("packing", packing),
]
#: SQL cannot express the classifier and the tokenizer; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
