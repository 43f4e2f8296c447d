"""The command line: python -m postloom <command>. Tables live in a warehouse; source answers are folders of fetched bodies."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom import schema
from postloom.functions.gazetteer import gazetteer, load_cities
from postloom.operators import discovery, eligibility, ingest, register, relevance, reports, snapshot
from postloom.operators.listing import JobsRepository, page_of, parse_filter
from postloom.operators.migrations import Migration, Warehouse, assign_markets, retire_legacy
from postloom.serving import api, logs
from postloom.serving.fixtures import FixtureRepository
from postloom.serving.settings import Settings, load
from postloom.sources import boards, config

TABLES = {"companies": schema.COMPANIES, "targets": schema.TARGETS, "jobs": schema.JOBS, "runs": schema.RUNS, "verdicts": schema.ELIGIBILITY}
#: Providers whose answers are full listings of one company's board.
LISTINGS: dict[str, Callable[[DataFrame], DataFrame]] = {"greenhouse": boards.greenhouse, "lever": boards.lever, "ashby": boards.ashby}


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def migrations(spark: SparkSession) -> list[Migration]:
    create = lambda _: {name: spark.createDataFrame([], kind) for name, kind in TABLES.items()}
    legacy = lambda t: t | {"jobs": retire_legacy(t["jobs"], now()), "targets": assign_markets(t["targets"])}
    return [Migration("tables", create, lambda t: {}), Migration("markets", legacy, lambda t: t)]


class Store:
    """The warehouse's current tables. A change is written beside the old table and then takes its place."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.warehouse = spark, Warehouse(spark, settings.warehouse, migrations(spark))

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.warehouse.path}/{self.warehouse.state()[0]}/{name}")

    def save(self, **tables: DataFrame) -> None:
        base = f"{self.warehouse.path}/{self.warehouse.state()[0]}"
        for name, df in tables.items():
            kind = self.spark.createDataFrame([], TABLES[name]).schema
            df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kind)).write.mode("overwrite").parquet(f"{base}/{name}.new")
        for name in tables:
            (new, fs), (old, _) = (self.warehouse._file(f"{self.warehouse.state()[0]}/{n}") for n in (f"{name}.new", name))
            fs.delete(old, True)
            fs.rename(new, old)


def migrate(store: Store, args: argparse.Namespace, settings: Settings) -> dict:
    w = store.warehouse
    if args.command == "migrate-up":
        return {"version": w.up()}
    if args.command == "migrate-down":
        return {"version": w.down() if args.all else w.step_down()}
    w.force(args.version)
    return {"version": args.version}


def discover(store: Store, args: argparse.Namespace, settings: Settings) -> dict:
    """Candidates from a seed file, or from search results, with what probes of their pages answered."""
    spark, at = store.spark, now()
    if args.command == "search-discover":
        found = discovery.boards_found(spark.read.schema("company_name string, rank int, url string").json(args.path)).where("problem is null")
        candidates = found.select("company_name", "ats_provider", "external_board_id", "board_url", F.lit(False).alias("verified"))
    else:
        kind = "company_name string, website string, ats_provider string, external_board_id string, board_url string, verified boolean"
        candidates = spark.read.schema(kind).option("multiLine", True).json(args.path).drop("website")
    probes = spark.read.schema("board_url string, method string, status int, at timestamp").json(args.probes) if args.probes else spark.createDataFrame([], "board_url string, method string, status int, at timestamp")
    good, bad = discovery.checked_candidates(candidates, probes)
    good = good.withColumn("ord", F.monotonically_increasing_id())
    null = F.lit(None).cast("string")
    companies = snapshot.upsert_companies(store["companies"], good.select(F.col("company_name").alias("name"), null.alias("website"), null.alias("description"), "ord"), at)
    store.save(companies=companies)
    ids = store["companies"].select(F.col("id").alias("company_id"), F.lower(F.trim("name")).alias("_key"))
    batch = good.withColumn("_key", F.lower(F.trim("company_name"))).join(ids, "_key").select("company_id", "ats_provider", "external_board_id", "board_url", "discovery_metadata", null.alias("market"), "ord")
    targets, taken = snapshot.upsert_targets(store["targets"], batch, at)
    refused = bad.count() + taken.count()
    store.save(targets=targets)
    return {"registered": good.count(), "refused": refused}


def seed_priority(store: Store, args: argparse.Namespace, settings: Settings) -> dict:
    entries = config.priority_companies(store.spark, args.path)
    companies, targets, refused = register.seed_priority(store["companies"], store["targets"], entries, now())
    counts = {"companies": entries.count(), "refused": refused.count()}
    store.save(companies=companies, targets=targets)
    return counts


def priority_report(store: Store, args: argparse.Namespace, settings: Settings) -> dict:
    report = reports.coverage(store["jobs"], store["companies"], store["targets"], now())
    head = reports.coverage_headline(report, store.spark.createDataFrame([], "name string")).first()
    print(reports.coverage_text(report.collect(), head))  # a row for each priority company
    return head.asDict()


def ingest_boards(store: Store, args: argparse.Namespace, settings: Settings) -> dict:
    """Answers at <path>/<provider>/<board>.json, each a full listing of a registered board. A board whose answer cannot be
    read fails alone."""
    spark, at, results = store.spark, now(), []
    for provider, read in LISTINGS.items():
        for file in sorted(Path(args.path, provider).glob("*.json")):
            found = store["targets"].where((F.col("ats_provider") == provider) & (F.lower("external_board_id") == file.stem.lower()) & F.col("is_active"))
            target = found.select("id", "company_id").first()
            if target is None:
                results.append((f"{provider}/{file.stem}", "not registered", 0, 0, 0, 0, 0))
                continue
            try:
                rows = read(boards.read_bodies(spark, str(file))).withColumns({"company_id": F.lit(target.company_id), "target_company_id": F.lit(target.id)})
                out = ingest.ingest(store["jobs"], rows, [target.id], at, work_path=f"{settings.warehouse}/work/{provider}-{file.stem}")
                n = reports.outcome_counts(out.outcomes).first()
                removed = out.rows.where((F.col("closed_at") == F.lit(at).cast("timestamp")) & (F.col("target_company_id") == target.id)).count()
                results.append((f"{provider}/{file.stem}", None, n.inserted, n.changed, n.unchanged, out.skipped.count(), removed))
                store.save(jobs=out.rows)
            except Exception as e:  # one board's answer must not stop the others
                results.append((f"{provider}/{file.stem}", str(e).split("\n")[0][:300], 0, 0, 0, 0, 0))
    kind = "name string, error string, inserted bigint, changed bigint, unchanged bigint, skipped bigint, removed bigint"
    report = ingest.run_report(spark.createDataFrame(results, kind)).first().asDict()
    if report["all_failed"]:
        raise RuntimeError(f"all {len(results)} boards failed")
    return report


def classify(store: Store, args: argparse.Namespace, settings: Settings) -> dict:
    profile = relevance.Profile.load(settings.profile) if settings.profile else relevance.SOFTWARE
    places = gazetteer(store.spark, load_cities(settings.cities) if settings.cities else None)
    pending = reports.pending_verdicts(store["jobs"], store["verdicts"], eligibility.VERSION, "ET", args.force)
    markets = store["targets"].select(F.col("id").alias("target_company_id"), "market")
    results = eligibility.classified(pending.join(markets, "target_company_id", "left"), places, now(), profile=profile).persist()
    counts = eligibility.stats(results).first().asDict()
    kind = store.spark.createDataFrame([], TABLES["verdicts"])
    store.save(verdicts=snapshot.save_verdicts(kind.unionByName(store["verdicts"]).withColumn("ord", F.lit(0)).drop("ord"), results.drop("failed").withColumn("ord", F.lit(0)), store["jobs"]))
    results.unpersist()
    return counts


def repository(store: Store | None, spark: SparkSession, settings: Settings) -> JobsRepository:
    if settings.repository == "fixtures" or store is None:
        return FixtureRepository(spark)
    return JobsRepository(store["jobs"], store["companies"], store["targets"], store["verdicts"])


def list_jobs(store: Store, args: argparse.Namespace, settings: Settings) -> dict:
    f = parse_filter(dict(x.split("=", 1) for x in args.filter))
    found = repository(store, store.spark, settings).found(f, now())
    rows = page_of(found, f).collect()
    for r in rows:
        print(f"{r.id}\t{r.title}\t{r.company}\t{r.location_raw or ''}")
    return {"total": rows[0].total if rows else 0}


def serve(store: Store, args: argparse.Namespace, settings: Settings) -> dict:
    http = api.server(repository(store, store.spark, settings), settings, logs.logger(settings.log_level, settings.log_format, sys.stderr))
    try:
        http.serve_forever()
    except KeyboardInterrupt:
        http.server_close()
    return {}


COMMANDS: dict[str, Callable[[Store, argparse.Namespace, Settings], dict]] = {
    "migrate-up": migrate, "migrate-down": migrate, "migrate-force": migrate, "discover": discover, "search-discover": discover, "seed-priority": seed_priority, "priority-report": priority_report,
    "ingest": ingest_boards, "classify": classify, "list": list_jobs, "serve": serve,
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="postloom", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        if name == "migrate-down":
            p.add_argument("--all", action="store_true")
        elif name == "migrate-force":
            p.add_argument("version", type=int)
        elif name in ("discover", "search-discover"):
            p.add_argument("path")
            p.add_argument("--probes", default="")
        elif name in ("seed-priority", "ingest"):
            p.add_argument("path")
        elif name == "classify":
            p.add_argument("--force", action="store_true")
        elif name == "list":
            p.add_argument("filter", nargs="*", help="name=value")
    return out


def main(arguments: list[str], spark: SparkSession | None = None, environment: dict[str, str] | None = None) -> int:
    """The exit status. The last line on standard output is the result as JSON; failures are logged to standard error."""
    args = parser().parse_args(arguments)
    try:
        settings = load(os.environ if environment is None else environment)
    except ValueError as e:
        logs.logger("info", "json", sys.stderr).error("the settings are wrong", extra={"fields": {"error": str(e)}})
        return 2
    log = logs.logger(settings.log_level, settings.log_format, sys.stderr)
    if spark is None:
        from postloom.session import local_session

        spark = SparkSession.getActiveSession() or local_session()
    try:
        result = COMMANDS[args.command](Store(spark, settings), args, settings)
    except Exception as e:
        log.error(f"{args.command} failed", extra={"fields": {"error": str(e).split(chr(10))[0]}})
        return 1
    print(json.dumps(result))
    log.info(f"{args.command} done", extra={"fields": result})
    return 0
