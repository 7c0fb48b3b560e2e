"""Line numbers of files that Spark reads in splits.

A split's rows stay in order and together within a task, so a line's number is the number
of rows in the earlier splits of its file, plus its place in its own. Counts per split are
a table of as many rows as there are splits; their prefix sums run file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame) -> DataFrame:
    """rows of a file source as it is read, with ``file``, ``modified`` and ``line`` (from 1) of each.

    Lines of a text source are numbered as they stand, empty ones included. A source that
    reads whole files (multi-line CSV) numbers its records.
    """
    at = F.monotonically_increasing_id()
    meta = lambda c: F.col(f"_metadata.file_{c}")
    marked = rows.select("*", meta("path").alias("file"), meta("modification_time").alias("modified"), meta("block_start").alias("_block"), at.alias("_at"))
    splits = marked.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = marked.join(splits, ["file", "_block"]).withColumn("line", F.col("_before") + F.col("_at") - F.col("_first") + 1)
    return out.select(*rows.columns, "file", "modified", "line")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file, modified, line of text files."""
    return numbered(spark.read.text(path))


def place() -> Column:
    """The order of hand-kept files: by name, then line."""
    return F.struct("file", "line")


def age() -> Column:
    """The order of files that were added one after another: by time, then name and line."""
    return F.struct("modified", "file", "line")
