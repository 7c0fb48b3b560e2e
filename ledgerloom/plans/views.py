"""Small helpers that lay the operators' inputs over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice(k: Column, values: tuple[str, ...]) -> Column:
    """One of the values, by k modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(k.cast("long"), F.lit(len(values))) + 1).cast("int"))

