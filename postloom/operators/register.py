"""Registering employers and the priority list as companies and targets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.names import company_key
from postloom.functions.text import collapse_space
from postloom.operators import snapshot

NAME_LENGTH = 200


def _flagged(companies: DataFrame, names: DataFrame, now: datetime) -> DataFrame:
    """companies with those in names (name) marked as priority; the mark is never taken away."""
    keys = names.select(company_key(F.col("name")).alias("_key")).distinct().withColumn("_flag", F.lit(True))
    joined = companies.withColumn("_key", company_key(F.col("name"))).join(keys, "_key", "left")
    newly = F.coalesce("_flag", F.lit(False)) & ~F.col("is_priority")
    new = {"is_priority": F.col("is_priority") | newly, "updated_at": F.when(newly, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in companies.columns))


def ensure_targets(companies: DataFrame, targets: DataFrame, employers: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables with a company and a target for every employer (employer, provider, priority, market, ord), and the
    employers refused: without a name, or with one that is too long. A target's board is the name in lower case."""
    e = employers.withColumn("name", collapse_space(F.col("employer")))
    usable = F.coalesce((F.col("name") != "") & (F.length("name") <= NAME_LENGTH) & (F.btrim("provider") != ""), F.lit(False))
    good, refused = e.where(usable), e.where(~usable)
    null = F.lit(None).cast("string")
    companies = snapshot.upsert_companies(companies, good.select("name", null.alias("website"), null.alias("description"), "ord"), now)
    companies = _flagged(companies, good.where("priority"), now)
    ids = companies.select(F.col("id").alias("company_id"), company_key(F.col("name")).alias("_key"))
    batch = good.withColumn("_key", company_key(F.col("name"))).join(ids, "_key").select("company_id", F.col("provider").alias("ats_provider"), F.lower("name").alias("external_board_id"), null.alias("board_url"), F.lit(None).cast("map<string,string>").alias("discovery_metadata"), "market", "ord")
    return companies, snapshot.upsert_targets(targets, batch, now)[0], refused


def seed_priority(companies: DataFrame, targets: DataFrame, entries: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables with the priority list (sources.config.priority_companies): each company flagged, with a target to search
    for it, one for each feed and one for each careers page; and the targets refused, whose board is another company's."""
    null = F.lit(None).cast("string")
    companies = _flagged(snapshot.upsert_companies(companies, entries.select("name", "website", null.alias("description"), "ord"), now), entries, now)
    ids = companies.select(F.col("id").alias("company_id"), company_key(F.col("name")).alias("_key"))
    board = lambda kind, values: F.transform(values, lambda u: F.struct(F.lit(kind).alias("provider"), F.btrim(u).alias("board"), F.btrim(u).alias("url")))
    search = F.array(F.struct(F.lit("search").alias("provider"), F.btrim("name").alias("board"), F.lit("").alias("url")))
    sources = entries.withColumn("_key", company_key(F.col("name"))).join(ids, "_key").select("company_id", "ord", F.explode(F.concat(search, board("feed", F.col("feeds")), board("careers-site", F.col("career_pages")))).alias("s"))
    batch = sources.select("company_id", F.col("s.provider").alias("ats_provider"), F.col("s.board").alias("external_board_id"), F.col("s.url").alias("board_url"), F.lit(None).cast("map<string,string>").alias("discovery_metadata"), F.lit("ethiopia").alias("market"), "ord")
    targets, refused = snapshot.upsert_targets(targets, batch, now)
    return companies, targets, refused
