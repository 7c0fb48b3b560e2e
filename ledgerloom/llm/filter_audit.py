"""What each filter of a chain removes, in every order of the chain, from one packed bitmap index.

1. Each partition lays its rows out part by part and packs one bit per row and filter,
   and one per row and label, into NumPy words; a part's bitset is a run of words, so
   restricting to a part is a slice. For each subset of filters the rows that pass all
   of it are AND-NOTs of the subset without its last filter; popcounts per run give, per
   part and subset, the rows that are left and those of each label.
2. Spark sums the counts of all partitions: 2**filters x (1 + labels) numbers a part.
3. Every figure of every order follows from these counts: what a step keeps depends on
   the set of filters so far and not on their order.

Rows never meet in a group: a part of any size costs a row per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import pick, ship, stored
from ._text import Words, buffer, pieces

#: Orders are written out, so their number is bounded.
MOST_FILTERS = 7
SYMBOLS = b"#$%&*|"


def packed(bits: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Words with the given bits at the given places."""
    out = np.zeros(words * 64, np.uint8)
    out[at] = bits
    return np.packbits(out).view(np.uint64)


def subset_counts(part: np.ndarray, filters: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(parts, counts[part, subset, 0 = all or 1 + label]) of the rows that no filter of the subset removes."""
    names, of, sizes = np.unique(part, return_inverse=True, return_counts=True)
    runs = (sizes + 63) // 64
    first = np.concatenate([[0], np.cumsum(runs)])
    order = np.argsort(of, kind="stable")
    at = np.empty(len(part), np.int64)
    at[order] = np.arange(len(part)) + np.repeat(first[:-1] * 64 - np.cumsum(sizes) + sizes, sizes)
    fails = [packed(f, at, int(first[-1])) for f in filters]
    wanted = [packed(x, at, int(first[-1])) for x in labels]
    alive = {0: packed(np.ones(len(part), bool), at, int(first[-1]))}
    counts = np.zeros((len(names), 1 << len(filters), 1 + len(labels)), np.int64)
    for subset in range(1 << len(filters)):
        if subset:
            last = subset.bit_length() - 1
            alive[subset] = alive[subset ^ 1 << last] & ~fails[last]
        for j, words in enumerate([alive[subset], *[alive[subset] & x for x in wanted]]):
            counts[:, subset, j] = np.add.reduceat(np.bitwise_count(words).astype(np.int64), first[:-1])
    return names, counts


def _index(n_filters: int, n_labels: int):
    """part, filters ..., labels ... -> a row of counts for each part of each batch."""
    names = [f"n{i}" for i in range((1 + n_labels) << n_filters)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode()
            bits = [batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(n_filters + n_labels)]
            at, counts = subset_counts(keys.indices.to_numpy(), bits[:n_filters], bits[n_filters:])
            flat = counts.reshape(len(at), -1)
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(at)), *[pa.array(flat[:, i]) for i in range(flat.shape[1])]], ["part", *names])

    return run, names


def _steps(filters: list[str], labels: list[str]):
    """Summed counts of each part -> a row for each order and step."""
    n = len(filters)
    orders = list(permutations(range(n)))
    which = np.array(orders)
    after = np.cumsum(1 << which, axis=1)
    before = after - (1 << which)
    everything = (1 << n) - 1
    text = pa.array(["".join(filters[i] for i in o) for o in orders])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                counts = np.array([batch.column(1 + i)[r].as_py() for i in range((1 + len(labels)) << n)], np.int64).reshape(1 << n, -1)
                kept = counts[:, 0]
                removed = kept[before] - kept[after]
                failing = kept[0] - kept[1 << which]
                shapley = np.bincount(which.ravel(), removed.ravel().astype(np.float64), n) if removed.sum() < 2**52 else np.array([removed[which == i].sum() for i in range(n)])
                lost = [counts[before, j] - counts[after, j] for j in range(1, 1 + len(labels))]
                figures = [kept[after], removed, failing - removed, kept[everything ^ 1 << which] - kept[everything], *lost, shapley.astype(np.int64)[which]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[r].as_py()] * which.size),
                        text.take(pa.array(np.repeat(np.arange(len(orders)), n))),
                        pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))),
                        *[pa.array(x.ravel()) for x in figures],
                    ],
                    ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in labels], "shapley"],
                )

    return run


def audit(rows: DataFrame, part: str, filters: list[str], labels: list[str]) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, <label>_lost, shapley.

    ``rows`` has a boolean column for each filter (true: the row fails it) and label;
    filter_order joins the filters' names. A null flag counts as false, a null part as
    the empty string. ``kept`` and ``removed`` are the step's; ``redundant`` rows fail its
    filter but went before; ``unique_fails`` fail it alone; ``shapley`` is the filter's
    removed rows summed over all orders. Repeated rows count as often as they stand there.
    An empty table gives an empty result. Other columns are ignored.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"{factorial(len(filters))} orders of {len(filters)} filters are more than can be written out")
    ship(rows.sparkSession)
    plain = pick(rows, part, *filters, *labels).toDF(*[f"c{i}" for i in range(1 + len(filters) + len(labels))])
    plain = plain.select(F.coalesce(F.col("c0").cast("string"), F.lit("")).alias("part"), *[F.coalesce(F.col(f"c{i}"), F.lit(False)).alias(f"c{i}") for i in range(1, 1 + len(filters) + len(labels))])
    run, names = _index(len(filters), len(labels))
    counts = plain.mapInArrow(run, f"part string, {', '.join(f'{n} long' for n in names)}")
    summed = counts.groupBy("part").agg(*[F.sum(n).alias(n) for n in names])
    figures = ["kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in labels], "shapley"]
    return summed.mapInArrow(_steps(filters, labels), f"part string, filter_order string, step int, {', '.join(f'`{x}` long' for x in figures)}")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part, text -> doc_id, part, conditions A to D, and a digest of the text for E."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        for a, texts in pieces(batch.column(2)):
            data, offs = buffer(texts)
            words = Words(data, offs)
            hashes, n = words.hashes(fold=False), words.counts()
            distinct = np.array([len(np.unique(hashes[i:j])) for i, j in zip(words.of, words.of[1:], strict=False)], np.int64)
            share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offs])  # noqa: B023, E731
            points, capitals = share((data & 0xC0) != 0x80), share((data >= 0x41) & (data <= 0x5A))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, len(texts)),
                    batch.column(1).slice(a, len(texts)),
                    pa.array(n < 200),
                    pa.array(100 * distinct < 50 * n),
                    pa.array(100 * capitals > 2 * points),
                    pa.array(share(symbol[data]) > 0),
                    pa.array([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(offs, offs[1:], strict=False)], pa.binary()),
                ],
                ["doc_id", "part", "A", "B", "C", "D", "digest"],
            )


def conditions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, the failure conditions A to E and the labels good and toxic of each row of docs(doc_id, text, source).

    A: under 200 words; B: less than half of them distinct; C: over 2 % of characters are
    A-Z; D: one of ``#$%&*|``; E: a smaller doc_id has the same text. Words are separated
    by ASCII white space. A null text is empty: it fails A, and E if a smaller doc_id's is
    empty too. A row with a null doc_id is smaller or larger than none and has no labels. Of
    several labels of one doc_id any one counts; rows of one doc_id are no copies of each other.
    """
    ship(docs.sparkSession)
    plain = pick(docs, "doc_id", "source", "text").toDF("doc_id", "part", "text")
    plain = plain.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("part").cast("string").alias("part"), F.col("text").cast("string").alias("text"))
    rows = stored(plain.mapInArrow(_measure, "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary"), "conditions")
    # written before the join, so that both sides are plain shuffles and Spark can split a hot text's partition
    copies = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "copies")
    marked = pick(labels, "doc_id", "quality", "toxic").toDF("doc_id", "quality", "toxic").filter("doc_id is not null")
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marked = stored(marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")), "labels")
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.join(copies, "digest", "left").withColumn("E", yes(F.col("doc_id") > F.col("first"))).drop("digest", "first")
    return rows.join(marked, "doc_id", "left").select("doc_id", "part", *"ABCDE", *[yes(F.col(c)).alias(c) for c in ("good", "toxic")])


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the conditions A to E of documents by source, with the labels good and toxic."""
    return audit(conditions(docs, labels), "part", list("ABCDE"), ["good", "toxic"])
