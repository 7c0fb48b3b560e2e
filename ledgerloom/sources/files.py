"""Readers and writers of the hand-kept files: ;-CSV, TSV, sidecars, logs, lists, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import sanitise, split_cell
from ..functions.normalize import norm_company, normalize_url, role_key, strip_seat_suffix, text
from ..operators.dedup import latest
from ..operators.registry import Refused
from .lines import age, numbered, place, read_lines

#: The registry's columns, in order.
REGISTRY = (
    "Company / Outreach Account;In Italy?;Locations;Master-fit Themes;Matching Job Titles;Matching Score;Job Links;Role Count;Curricular Evidence;Work Modes;"
    "Sources / Portals;Previously Contacted?;Contact Search Status;Contact Name;Contact Role;Contact Email / LinkedIn;Outreach Decision;Notes;"
    "Verification Status;Last Checked;First Contact Date;Recall"
).split(";")
EVIDENCE = ("url", "posted", "alternate_urls", "search_query")
CHECKS = ("url", "label", "reachable", "has_apply", "has_intern_signal", "title", "status", "detail", "elapsed_ms")
NAME = REGISTRY[0]


def read_semicolon(spark: SparkSession, path: str | list[str], required: tuple[str, ...] = ()) -> DataFrame:
    """;-CSV with quoted line ends; all columns strings, with ``idx`` (file, record) for the order. A missing column is refused."""
    df = spark.read.csv(path, sep=";", header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    df = df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise Refused([f"{path}: no column {c!r}" for c in missing])
    return numbered(df).withColumn("idx", place()).drop("file", "modified", "line")


def write_semicolon(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*[sanitise(F.col(f"`{c}`")).alias(c) for c in columns]).write.csv(path, sep=";", header=True, quote='"', escape='"', emptyValue="")


def history(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(norm_company, url_norm) and (norm_company, role_key) of a registry; repeated headers and nameless rows are skipped."""
    rows = registry.filter((F.trim(text(F.col(f"`{NAME}`"))) != "") & (F.col(f"`{NAME}`") != NAME))
    rows = rows.withColumn("norm_company", norm_company(F.col(f"`{NAME}`")))
    urls = rows.select("norm_company", F.explode(split_cell(F.col("`Job Links`"), "Job Links")).alias("u")).select("norm_company", normalize_url(F.col("u")).alias("url_norm"))
    titles = rows.select("norm_company", F.col(f"`{NAME}`").alias("company"), split_cell(F.col("Locations"), "Locations").alias("locs"), F.posexplode(split_cell(F.col("`Matching Job Titles`"), "Matching Job Titles")).alias("i", "t"))
    keys = titles.select("norm_company", role_key(F.col("company"), strip_seat_suffix(F.col("t")), F.coalesce(F.get("locs", F.col("i")), F.get("locs", F.lit(0)), F.lit(""))).alias("role_key"))
    return urls.distinct(), keys.distinct()


def read_tsv(spark: SparkSession, path: str | list[str], columns: list[str] = REGISTRY) -> DataFrame:
    """Tab-separated rows of exactly the columns, with ``n`` (file, line); every row of another width is refused, the first ten named.

    Read as text: the CSV reader would pad or cut such rows in silence.
    """
    lines = read_lines(spark, path).withColumn("n", place()).withColumn("f", F.split(F.regexp_replace("value", "\r$", ""), "\t"))
    lines = lines.filter(F.trim("value") != "")
    bad = lines.filter(F.size("f") != len(columns)).orderBy("n").select("n", F.size("f")).limit(10).collect()
    if bad:
        raise Refused([f"{r[0]['file'].rpartition('/')[2]}, line {r[0]['line']}: {r[1]} fields, not {len(columns)}" for r in bad])
    first = F.trim(F.get("f", F.lit(0)))
    rows = lines.filter((first != "") & ~first.startswith("[") & (first != columns[0]))
    return rows.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)], "n")


def sidecar(df: DataFrame, required: tuple[str, ...], key: str = "url", order: str = "idx") -> DataFrame:
    """Rows by normalised url, the last one winning."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise Refused([f"no column {c!r}" for c in missing])
    return latest(df.withColumn("url_norm", normalize_url(F.col(key))), "url_norm", order)


def read_log(spark: SparkSession, path: str | list[str], schema: str = "key string, cards array<struct<title string, url string>>") -> DataFrame:
    """Files of JSON lines that were added one after another: torn lines are skipped, the last line of a key in the newest file wins.

    Files of one age go by their names. A log whose order must not hang on files' times is a runlog.
    """
    df = read_lines(spark, path).withColumn("idx", age()).withColumn("r", F.from_json("value", f"{schema}, _corrupt_record string"))
    df = df.filter("r is not null and r._corrupt_record is null and r.key is not null")
    return latest(df.select("r.*", "idx").drop("_corrupt_record"), "key", "idx").drop("idx")


def read_aggregators(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """pattern, note, entry_ord (file, line); comments and the header are skipped, a note may hold semicolons."""
    lines = read_lines(spark, path).withColumn("entry_ord", place()).filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    parts = F.split("value", ";", 2)
    return lines.select(F.trim(F.get(parts, 0)).alias("pattern"), F.coalesce(F.trim(F.get(parts, 1)), F.lit("")).alias("note"), "entry_ord").filter("pattern <> 'pattern' and pattern <> ''")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """label, url of lines of urls, each with an optional label before ; or a tab."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not v like '#%'")
    label = F.regexp_extract("v", "^([^;\t]*)[;\t]\\s*(\\S+)$", 1)
    url = F.regexp_extract("v", "^([^;\t]*)[;\t]\\s*(\\S+)$", 2)
    return lines.select(F.when(url != "", F.trim(label)).otherwise("").alias("label"), F.when(url != "", url).otherwise(F.col("v")).alias("url"))


def write_artifacts(outcomes: DataFrame, path: str) -> None:
    """All rows, partitioned by outcome, so each bucket is a folder and none is lost."""
    outcomes.write.partitionBy("outcome").parquet(path)


def manifest(contents: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    return contents.select(name, F.sha2(F.col(body), 256).alias("sha256"), F.octet_length(body).cast("long").alias("bytes"))
