"""Bounded samples of labelled documents, and the fold that is held out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import pick, ship, stored
from ._text import pieces


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose crc32(doc_id as text) is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label and text of the documents of at most ``most`` labelled ids outside the held-out fold.

    The ids are those of the least hash, so the choice hangs on nothing but themselves.
    They are sent to every task, as there are so few. Of texts with one id the least
    counts, however many there are.
    """
    named = pick(labels, "doc_id", label).toDF("doc_id", "label").filter("doc_id is not null and label is not null")
    named = named.select("doc_id", F.expr("cast(label > 0 as int)").alias("label")).distinct()
    some = named.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    docs = pick(docs, "doc_id", "text").filter("doc_id is not null")
    named = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return stored(named, "sample")


def features(some: DataFrame, make: Callable[[pa.Array, list[int]], list[bytes]]) -> list[tuple[bytes, int]]:
    """(features, label) of the sample's documents, in the order of their ids.

    ``make`` gives a bounded number of bytes for each of a batch of texts and ids; it runs
    on the executors, and texts stay there.
    """
    ship(some.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in pieces(batch.column(2)):
                ids = batch.column(0).slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(a, len(texts)), pa.array(make(texts, ids.to_pylist()), pa.binary())], ["doc_id", "label", "made"])

    made = some.mapInArrow(run, f"doc_id {some.schema['doc_id'].dataType.simpleString()}, label int, made binary")
    return [(bytes(r.made), r.label) for r in sorted(made.collect(), key=lambda r: (r.doc_id, r.label))]
