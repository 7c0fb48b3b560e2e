"""Tables and folders that the driver and all executors share, and shipping of this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

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
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


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
        fs, at = _hadoop(table.sparkSession, table.stored_at)
        fs.delete(at, True)


def ship(spark: SparkSession | None = None) -> None:
    """Make this package importable on executors, whatever their PYTHONPATH; once an application."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-zip-"), f"{top.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)
