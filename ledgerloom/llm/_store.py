"""Intermediate tables in the folder that all executors share, and shipping of this package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on this machine alone gets a temporary one if it names none."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and lost executors cost nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them is written."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, whatever their PYTHONPATH."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-zip-"), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def numbered(df: DataFrame) -> DataFrame:
    """All columns, named c0, c1, ...: names that differ in case only, or not at all, are no trouble then."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact spelling, whatever else the table holds."""
    have = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    if len(set(map(str.lower, df.columns))) == len(df.columns):
        return df.select(*[F.col(f"`{n}`") for n in names])
    return numbered(df).select(*[F.col(f"c{have[n]}").alias(n) for n in names])
