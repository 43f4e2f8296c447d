"""Chat formatting: logged snapshots of growing conversations collapse into the longest, which is rendered.

A conversation that was logged again after more turns stands in the log as a prefix of a longer one. Every conversation gives
the rolling hash of each of its turn prefixes; an anti-join drops those whose whole hash is a proper prefix's hash of another
one, and of equal conversations all but one. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import materialize

#: Fixed values of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rolling(turns: Column) -> Column:
    """Digests of the turn prefixes, the shortest first: each is the SHA-256 of the one before and the turn's own, so it
    depends on all turns, their order and where each role and text ends."""
    own = lambda t: F.sha2(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], F.lit(":"), t["text"]), 256)
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))

    def step(state: Column, turn: Column) -> Column:
        digest = F.sha2(F.concat(state["last"], own(turn)), 256)
        return F.struct(digest.alias("last"), F.concat(state["all"], F.array(digest)).alias("all"))

    return F.aggregate(turns, start, step, lambda s: s["all"])


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def collapse_snapshots(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, chat (the rendered text).

    Turns are ordered by number, then role and text; null numbers come first, null roles and texts count as empty. Rows that
    repeat a turn are turns of their own. Of equal conversations the smallest identifier stays; rows without an identifier
    are one conversation, which stays rather than its equals. An empty table gives no rows; other columns are ignored. A
    conversation is one row, so one of any length has to fit into a task; its digests are gathered turn by turn, which takes
    some 5 seconds for 16,000 turns and grows with their square, while texts may be of any length.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    convs = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), rolling(F.col("turns")).alias("hashes"), render(F.col("turns")).alias("chat"))
    convs = materialize(convs, "conversations")
    whole = convs.select("conv_id", "n_turns", F.element_at("hashes", -1).alias("hash"))
    distinct = whole.groupBy("n_turns", "hash").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("named"), "conv_id")).alias("first"))
    proper = convs.select(F.explode(F.slice("hashes", 1, F.col("n_turns").cast("int") - 1)).alias("hash")).distinct()
    kept = materialize(distinct.join(proper, "hash", "left_anti").select(F.col("first.conv_id").alias("_kept")), "maximal-conversations")
    return convs.join(kept, F.col("conv_id").eqNullSafe(F.col("_kept")), "left_semi").select("conv_id", "n_turns", "chat")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_snapshots(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
    SELECT conv_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n_turns,
        string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS prefix
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), whole AS (
    SELECT min(conv_id) AS conv_id, prefix FROM p WHERE k = n_turns GROUP BY prefix
), kept AS (
    SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE k < n_turns)
)
SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS chat
FROM t WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id
"""
QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES = {"op4_chat_format": ORACLE}
