"""Python data sources of paged results, in batch and as a stream that goes on where it stopped.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("root", folder).option("queries", "a|b").option("places", "x|y").load()

A unit is a (query, place); its pages are ``root/<query>/<place>/<number>.html``, read up to
the first that is missing, or up to ``pages`` of them where that is given. ``StoredPages``
reads them from a Parquet table partitioned by query and place instead. A network fetcher
has the same shape: override ``fetch``. All requests of a source are sent ``gap_seconds``
apart, whatever the number of tasks: the units are dealt to ``lanes`` partitions (one by
default), and each lane waits lanes times the gap.

As a stream the source's offset is the number of units that are done, in the order of
queries and places, and a digest of them, so that a checkpoint of other queries is refused
while one to which queries were added is not. A batch reads ``units_per_batch`` of them (all
by default). A batch that was cut off is planned again from the checkpoint with the same
units, and a sink of Spark's keeps each page of it once. What a new process can't know, the
offset that the last planned batch ends at, is in a small file named by ``progress``.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator

from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.registry import Refused
from ..storage import exists, ship
from .runlog import store

Unit = tuple[str, str, int]
SCHEMA = "query string, place string, page int, html string, ord long"


class Lane(InputPartition):
    """(query, place, ord) of the units that one task reads, in turn."""

    def __init__(self, number: int, pairs: list[Unit]):
        self.number, self.pairs = number, pairs


class Pages:
    """What both readers share: the units that the options name, and how a lane is read."""

    def __init__(self, options: dict):
        split = lambda k: [x for x in options.get(k, "").split("|") if x]
        self.root = options["root"]
        self.queries, self.places, self.done = split("queries"), split("places"), set(split("done"))
        self.gap = float(options.get("gap_seconds", 0))
        self.pages = int(options["pages"]) if "pages" in options else None
        self.lanes = int(options.get("lanes", 1 if self.gap else max(1, len(self.queries) * len(self.places))))

    def units(self) -> list[Unit]:
        return [(q, p, i) for i, (q, p) in enumerate((q, p) for q in self.queries for p in self.places)]

    def dealt(self, units: list[Unit]) -> list[Lane]:
        return [Lane(n, units[n :: self.lanes]) for n in range(self.lanes) if units[n :: self.lanes]]

    def fetch(self, query: str, place: str, page: int) -> str | None:
        path = os.path.join(self.root, query, place, f"{page}.html")
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return f.read()

    def pages_of(self, query: str, place: str) -> Iterator[str]:
        """The pages of a unit, from 0, each fetched when it is asked for."""
        page = 0
        while (html := self.fetch(query, place, page)) is not None:
            yield html
            page += 1

    def read(self, partition: Lane) -> Iterator[tuple]:
        time.sleep(partition.number * self.gap)  # lanes start one gap apart and stay so
        sent = False
        for query, place, ord_ in partition.pairs:
            pages, page = self.pages_of(query, place), 0
            while self.pages is None or page < self.pages:
                if sent and self.gap:
                    time.sleep(self.lanes * self.gap)
                sent = True
                html = next(pages, None)
                if html is None:
                    break
                yield query, place, page, html, (ord_ << 32) + page
                page += 1


class StoredPagesOf(Pages):
    """Pages from a Parquet table of (page, html), partitioned by query and place."""

    def pages_of(self, query: str, place: str) -> Iterator[str]:
        files, root = store(self.root)
        path = f"{root}/query={query}/place={place}"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return
        for batch in dataset.dataset(path, filesystem=files, format="parquet").scanner(columns=["page", "html"]).to_table().sort_by("page").to_batches():
            yield from batch.column("html").to_pylist()


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, pages: type[Pages] = Pages):
        self.pages = pages(options)

    def partitions(self) -> list[Lane]:
        return self.pages.dealt([u for u in self.pages.units() if f"{u[0]} — {u[1]}" not in self.pages.done])

    def read(self, partition: Lane) -> Iterator[tuple]:
        return self.pages.read(partition)


def planned(progress: str) -> int:
    """The units up to the end of the last batch that was planned."""
    to, path = store(progress)
    if to.get_file_info(path).type == fs.FileType.NotFound:
        return 0
    with to.open_input_stream(path) as f:
        return json.loads(f.read())["units"]


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, pages: type[Pages] = Pages):
        self.pages = pages(options)
        self.step = int(options["units_per_batch"]) if "units_per_batch" in options else None
        self.progress = options.get("progress")
        if self.step is not None and not self.progress:
            raise ValueError("units_per_batch needs a progress file")
        self.last: int | None = None

    def offset(self, units: int) -> dict:
        """The offset after so many units, with a digest of which they are."""
        return {"units": units, "of": hashlib.sha256(json.dumps(self.pages.units()[:units]).encode()).hexdigest()[:16]}

    def initialOffset(self) -> dict:
        return self.offset(0)

    def latestOffset(self) -> dict:
        total = len(self.pages.units())
        return self.offset(total if self.step is None else min(total, (planned(self.progress) if self.last is None else self.last) + self.step))

    def partitions(self, start: dict, end: dict) -> list[Lane]:
        for x in (start, end):
            if x != self.offset(x["units"]):
                raise ValueError("the checkpoint belongs to other queries or places")
        if self.step is not None:
            to, path = store(self.progress)
            with to.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(end).encode())
            to.move(f"{path}.new", path)
        self.last = end["units"]
        return self.pages.dealt(self.pages.units()[start["units"] : end["units"]])

    def read(self, partition: Lane) -> Iterator[tuple]:
        return self.pages.read(partition)


class PagedSource(DataSource):
    pages: type[Pages] = Pages

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options, self.pages)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStreamReader(self.options, self.pages)


class StoredPages(PagedSource):
    pages = StoredPagesOf

    @classmethod
    def name(cls) -> str:
        return "stored_pages"


def check_resume(log_exists: bool, resume: bool) -> None:
    """An earlier run's log is neither overwritten nor taken up unasked."""
    if log_exists and not resume:
        raise Refused(["a checkpoint of an earlier run exists: resume it, or name another"])


def collect(spark: SparkSession, options: dict[str, str], to: str, source: type[PagedSource] = PagedSource, resume: bool = False, batches: int | None = None) -> DataFrame:
    """Every page of the units once, as rows below ``to``, though runs may be cut off; what is there so far.

    ``to`` holds the run's checkpoint beside its pages; one of an earlier run is refused
    unless ``resume``. ``batches`` ends the run after so many, as a stop would.
    """
    check_resume(exists(spark, f"{to}/checkpoint"), resume)
    ship(spark)
    spark.dataSource.register(source)
    progress = f"{to}/progress.json"
    total = len(source.pages(options).units())
    if not total:
        return spark.createDataFrame([], SCHEMA)
    while batches is None or batches > 0:
        stream = spark.readStream.format(source.name()).options(**{"units_per_batch": total} | options | {"progress": progress}).load()
        q = stream.writeStream.format("parquet").option("path", f"{to}/pages").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        if planned(progress) >= total:
            break
        batches = None if batches is None else batches - 1
    return spark.read.schema(SCHEMA).parquet(f"{to}/pages")
