"""A log of finished units, appended to by batches and read in the order of its writing.

    append(done, path)
    read(spark, path, "key string, ...")        # and batch, seq
    latest(read(...), "key")

Each task of an append writes a file of JSON lines that nobody reads yet. Only when all have
succeeded, the commit names the next batch and lists its files with the sequence number at
which each begins, in one file that comes into being at once or not at all. So every
row has a batch and a sequence number that no file size, listing or retry can change, and
files of a failed append, which no commit lists, are never read. The rows keep the order of
the appended DataFrame: sort it to give the numbers a meaning.

Paths may be of any store that pyarrow knows. In a POSIX folder two writers can't commit
one batch; elsewhere one writer at a time is expected.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.dedup import latest as last_rows
from ..storage import exists, ship
from .lines import numbered

COMMITS, DATA = "commits", "data"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    rows: int


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


class RunLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "runlog"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a run log is appended to, never overwritten")
        return RunLogWriter(self.options["path"])


class RunLogWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        to, root = store(self.path)
        task = TaskContext.get()
        name = f"{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}.jsonl"
        to.create_dir(f"{root}/{DATA}", recursive=True)
        rows = 0
        with to.open_output_stream(f"{root}/{DATA}/{name}") as out:
            for batch in iterator:
                out.write("".join(json.dumps(r, default=str, ensure_ascii=False) + "\n" for r in batch.to_pylist()).encode())
                rows += batch.num_rows
        return Written(task.partitionId(), name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        to, root = store(self.path)
        to.create_dir(f"{root}/{COMMITS}", recursive=True)
        files, start = [], 0
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            files.append({"file": m.file, "start": start, "rows": m.rows})
            start += m.rows
        taken = [int(i.base_name.split(".")[0]) for i in to.get_file_info(fs.FileSelector(f"{root}/{COMMITS}")) if i.extension == "jsonl" and i.base_name.split(".")[0].isdigit()]
        batch = max(taken, default=-1) + 1
        while not create(to, f"{root}/{COMMITS}/{batch:012d}.jsonl", "".join(json.dumps({"batch": batch} | f) + "\n" for f in files)):
            batch += 1

    def abort(self, messages: list[Written | None]) -> None:
        to, root = store(self.path)
        for m in messages:
            if m and to.get_file_info(f"{root}/{DATA}/{m.file}").type != fs.FileType.NotFound:
                to.delete_file(f"{root}/{DATA}/{m.file}")


def create(to: fs.FileSystem, path: str, text: str) -> bool:
    """Write a whole file that isn't there yet; False if it is."""
    if isinstance(to, fs.LocalFileSystem):
        whole = os.path.join(os.path.dirname(path), f"_{uuid.uuid4().hex}")
        with open(whole, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(whole, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(whole)
        return True
    if to.get_file_info(path).type != fs.FileType.NotFound:
        return False
    with to.open_output_stream(path) as out:
        out.write(text.encode())
    return True


def append(done: DataFrame, path: str) -> None:
    """Add the rows of ``done``, in its order, as one batch; all of them or none."""
    ship(done.sparkSession)
    done.sparkSession.dataSource.register(RunLog)
    done.write.format("runlog").mode("append").save(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed rows with ``batch`` and ``seq`` (both from 0). A log that nobody has written to is empty; a torn line is skipped."""
    if not exists(spark, f"{path}/{COMMITS}"):
        return spark.createDataFrame([], f"{schema}, batch long, seq long")
    commits = spark.read.schema("batch long, file string, start long, rows long").json(f"{path}/{COMMITS}").filter("rows > 0")
    lines = numbered(spark.read.text(f"{path}/{DATA}")).withColumn("file", F.element_at(F.split("file", "/"), -1))
    rows = lines.join(commits, "file").withColumn("r", F.from_json("value", f"{schema}, _corrupt_record string"))
    rows = rows.filter("r is not null and r._corrupt_record is null")
    return rows.select("r.*", "batch", (F.col("start") + F.col("line") - 1).alias("seq")).drop("_corrupt_record")


def latest(log: DataFrame, key: str) -> DataFrame:
    """The row of each key that was written last."""
    return last_rows(log.withColumn("_order", F.struct("batch", "seq")), key, "_order").drop("_order")
