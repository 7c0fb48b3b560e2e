"""python -m ledgerloom COMMAND ...: queries over tables, and the steps of the workflow over Parquet tables."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gates, matching, publishing, workflow
from .operators.registry import Refused
from .plans import discovery, registry


def _discover(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from .sources.paged import check_resume

    check_resume(publishing.current_version(spark, a.out) > 0, a.resume)
    config = discovery.Config(json.loads(a.areas), top_k=a.top)
    return discovery.run(spark.read.parquet(a.cards), config, spark.read.parquet(a.aggregators), (spark.read.parquet(a.urls), spark.read.parquet(a.keys)))


def _fetch(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from .sources import paged

    return paged.collect(spark, {"root": a.root, "queries": a.queries, "places": a.places, "units_per_batch": "8"}, a.to, resume=a.resume)


def _read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    out = workflow.read_report(spark.read.parquet(a.postings), spark.read.parquet(a.held), spark.read.parquet(a.answers))
    return out.orderBy("ord").limit(a.top) if a.top else out


def _verify(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    pages = spark.read.parquet(a.pages).withColumns(gates.page_signals(F.col("html")))
    return pages.withColumn("status", gates.verify_status(F.col("reachable"), F.col("kind"), F.col("detail"), F.col("title"), F.col("has_intern"), F.col("has_apply")))


def _admit(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = spark.read.parquet(a.declared)
    admitted = F.array(*map(F.lit, a.languages.split(",")))
    ok = gates.languages_satisfiable(F.col("requiredLanguages"), admitted, F.col("languageRequirement"))
    return rows.withColumn("ground", gates.admissibility(F.col("title"), F.lit(""), F.col("stageNature"), F.col("workMode"), F.col("applicationOpen"), ok))


def _stage(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    tables = [spark.read.parquet(x) for x in (a.companies, a.evidence, a.checks, a.owned)]
    return workflow.stage(*tables, None if a.dry_run else a.to, a.lenient)[1]


def _doctor(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return workflow.doctor(spark.read.parquet(a.companies))


def _init_review(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    workflow.init_review(spark.read.parquet(a.companies), a.columns.split(","), a.to, a.force)
    return publishing.published(spark, a.to)


def _harvest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return matching.value_changes(spark.read.parquet(a.was), spark.read.parquet(a.now), a.key, a.columns.split(","), ())


def _export(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return publishing.exported(spark.read.parquet(a.review), a.columns.split(","), a.key)


#: name -> (what it does, how, named inputs, flags)
COMMANDS: dict[str, tuple[str, Callable, tuple[str, ...], tuple[str, ...]]] = {
    "discover": ("cards through all gates, an outcome each", _discover, ("cards", "aggregators", "urls", "keys", "areas"), ("resume",)),
    "fetch": ("pages of queries (a|b) at places, each once, over as many runs as it takes", _fetch, ("root", "queries", "places", "to"), ("resume",)),
    "read": ("what became of each posting", _read, ("postings", "held", "answers"), ()),
    "verify": ("status of employers' pages", _verify, ("pages",), ()),
    "admit": ("the ground on which a role is refused, or none", _admit, ("declared", "languages"), ()),
    "stage": ("validate, explode, enrich, seed and publish the registry", _stage, ("companies", "evidence", "checks", "owned", "to"), ("lenient", "dry-run")),
    "doctor": ("health of the registry", _doctor, ("companies",), ()),
    "init-review": ("a first review", _init_review, ("companies", "columns", "to"), ("force",)),
    "harvest": ("cells that changed", _harvest, ("was", "now", "key", "columns"), ()),
    "export-history": ("the registry's columns of a review", _export, ("review", "columns", "key"), ()),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ledgerloom")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="list the queries")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query", choices=sorted(registry.queries()))
    run.add_argument("tables")
    run.add_argument("out", nargs="?", help="folder for the rows as Parquet; without it the first are shown")
    for name, (what, _, inputs, flags) in COMMANDS.items():
        sub = commands.add_parser(name, help=what)
        for x in inputs:
            sub.add_argument(f"--{x}", required=True)
        for x in flags:
            sub.add_argument(f"--{x}", action="store_true")
        sub.add_argument("--out", help="folder in which the rows are published as a new version; without it the first are shown")
        if name in ("discover", "read"):
            sub.add_argument("--top", type=int, default=100 if name == "discover" else 0)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "queries":
        print("\n".join(sorted(registry.queries())))
        return 0
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    try:
        if args.command == "run":
            df = registry.queries()[args.query](spark, args.tables)
            df.write.parquet(args.out) if args.out else df.show(20, False)
            return 0
        if args.command == "discover" and not args.out:
            raise Refused(["discover needs --out"])
        df = COMMANDS[args.command][1](spark, args)
        publishing.publish(df, args.out) if args.out else df.show(20, False)
    except Refused as e:
        print(f"refused: {e}")
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
