"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased and cut into runs of letters and digits; where these stand without
spaces (ideographs, kana), each is a token. Under a fixed mask a window of tokens is
hashed at the mask's 1 positions only, so a substituted token at a 0 changes nothing;
several masks together find a copy whose tokens are changed here and there. Equal hashes
of a test item and a document give a hit on a diagonal (document position minus item
position). Each diagonal is verified on whole texts. It is a leak if

* the best run of aligned tokens, with MISMATCH against every changed token, holds LEAST
  equal tokens; or
* the whole item is aligned, and SHARE of its tokens are equal, LEAST_EQUAL at least.

An item shorter than the masks has masks of its own, which leave out one token each, and
is found with one changed token at most; one of fewer than CHANGEABLE tokens is found
unchanged only. One of fewer than LEAST_ITEM tokens ("yes") says nothing within a text:
only a text of just these tokens holds it.

Of all diagonals of an item and a document the one with most equal tokens counts, and of
these the first; they are verified in the order of their hits, up to one where the whole
item is equal. Repetitive texts, where a window of a document hits an item at many
places, have no more diagonals than tokens; their hits are counted by convolution, not
listed.

The test items are read in chunks of at most CHUNK_TOKENS tokens, so what is sent to
every task is bounded; a larger benchmark takes more passes over the documents, each
written before the next.
Training rows are never joined, collected or grouped, so no key can be hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import numbered, pick, ship, stored
from ._text import PUNCT, Words, constants, mix, pieces
from ._units import spans

#: Fixed masks of span 10 and weight 6.
MASKS = ("1110100101", "1101100011", "1010111001", "1100101101")
SPAN = 10
CHUNK_TOKENS = 1_000_000
LEAST, MISMATCH = 10, 2
SHARE, LEAST_EQUAL = 0.6, 8
CHANGEABLE, LEAST_ITEM = 5, 3
#: Pairs of positions beyond which hits of one hash are counted by convolution.
MANY = 1 << 14
#: Diagonals of an item that are verified at first, and tokens that are compared at a time.
FIRST, COMPARED = 16, 1 << 20
_BITS = 22


def tokens(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of the lower-cased texts and their hashes."""
    w = Words.of_column(pc.utf8_lower(texts), PUNCT)
    wide = np.flatnonzero((w.data >= 0xE3) & (w.data <= 0xE9))  # U+3000 to U+9FFF begin so, three bytes each
    if len(wide):
        starts = np.union1d(w.starts, np.concatenate([wide, np.setdiff1d(wide + 3, w.ends)]))
        ends = np.union1d(w.ends, np.concatenate([np.setdiff1d(wide, w.starts), wide + 3]))
        mark = (w.data[starts] == 0xE3) & (w.data[np.minimum(starts + 1, len(w.data) - 1)] == 0x80)  # U+3000 to U+303F
        w.starts, w.ends = starts[~mark], ends[~mark]
        w.of = np.searchsorted(w.starts, w.offs)
    return w, w.hashes()


def seeds(hashes: np.ndarray, of: np.ndarray, positions: list[int], span: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of each window of ``span`` tokens within one text, over the given positions."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = constants(span, 40 + seed)
    x = hashes[positions[0] : positions[0] + n] * c[positions[0]]
    for p in positions[1:]:
        x += hashes[p : p + n] * c[p]
    fits = np.ones(n, bool)
    for e in of[1:-1]:
        fits[max(0, e - span + 1) : min(n, e)] = False
    at = np.flatnonzero(fits)
    return mix(x[at]), at


@dataclass
class Index:
    """Seed hashes of test items, ascending, with the item and token position of each."""

    ids: list[int]
    tokens: np.ndarray  # of all items
    of: np.ndarray  # first token of each item, and the end
    kinds: list[tuple[list[int], int, int]]  # positions, span, seed
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    bloom: np.ndarray

    @classmethod
    def build(cls, ids: list[int], texts: list[str]) -> Index:
        w, h = tokens(pa.array(texts, pa.large_string()))
        sizes = w.counts()
        kinds = [([i for i, b in enumerate(m) if b == "1"], SPAN, s) for s, m in enumerate(MASKS)]
        for n in sorted({int(n) for n in sizes if 0 < n < SPAN}):
            left_out = range(n) if n >= CHANGEABLE else [n]
            kinds += [([i for i in range(n) if i != out], n, 10 + SPAN * n + out) for out in left_out]
        hashes, items, ats = [], [], []
        owner = w.owner()
        for positions, span, seed in kinds:
            x, at = seeds(h, w.of, positions, span, seed)
            whole = (sizes[owner[at]] == span) if span < SPAN else np.ones(len(at), bool)
            hashes.append(x[whole])
            items.append(owner[at][whole])
            ats.append((at - w.of[owner[at]])[whole])
        x, item, at = map(np.concatenate, (hashes, items, ats))
        order = np.argsort(x, kind="stable")
        bloom = np.zeros(1 << _BITS, bool)
        bloom[x >> np.uint64(64 - _BITS)] = True
        return cls(list(ids), h, w.of, kinds, x[order], item[order], at[order], bloom)


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(first, end, equal tokens) of the run of the greatest score: 1 for each equal token, -MISMATCH for any other."""
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    first = int(np.flatnonzero(score[: end + 1] == low[end])[-1])
    return first, end, int(equal[first:end].sum())


def needed(n: int) -> int:
    """Equal tokens that a wholly aligned item of n tokens has at least."""
    if n < CHANGEABLE:
        return n
    return n - 1 if n < SPAN else max(LEAST_EQUAL, math.ceil(SHARE * n))


def verdict(equal: np.ndarray, n: int, n_text: int) -> tuple[int, int, int] | None:
    """(first, end, equal tokens) within an alignment of an item of n tokens and a text of n_text; None if it is no leak."""
    total = int(equal.sum())
    whole = (0, len(equal), total) if len(equal) == n and total >= needed(n) else None
    if n < SPAN:
        return whole if n >= LEAST_ITEM or n_text == n else None
    run = best_run(equal)
    return max((x for x in (whole, run if run[2] >= LEAST else None) if x), key=lambda x: x[2], default=None)


def differences(p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of p[i] - e[j], ascending; number of pairs of each)."""
    if len(p) * len(e) <= MANY:
        return np.unique(p[:, None] - e, return_counts=True)
    low_p, high_e = int(p.min()), int(e.max())
    x, y = (np.bincount(v).astype(float) for v in (p - low_p, high_e - e))
    n = 1 << (len(x) + len(y) - 2).bit_length()
    count = np.rint(np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(y, n), n)[: len(x) + len(y) - 1]).astype(np.int64)
    at = np.flatnonzero(count)
    return at + low_p - high_e, count[at]


def diagonals(index: Index, w: Words, h: np.ndarray) -> np.ndarray:
    """(row, item, diagonal, hits) of every diagonal with a hit, by row and item, those with most hits first."""
    owner = w.owner()
    base = int(np.diff(index.of).max(initial=0))
    size = len(h) + base + 1
    keys, counts = [], []
    for positions, span, seed in index.kinds:
        x, at = seeds(h, w.of, positions, span, seed)
        maybe = np.flatnonzero(index.bloom[x >> np.uint64(64 - _BITS)])
        x, at = x[maybe], at[maybe]
        a, b = np.searchsorted(index.hashes, x, "left"), np.searchsorted(index.hashes, x, "right")
        hit = np.flatnonzero(b > a)
        order = hit[np.lexsort((at[hit], a[hit], owner[at[hit]]))]
        at, a, b = at[order], a[order], b[order]
        row = owner[at]
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1])
        first = np.flatnonzero(new)
        windows_ = np.diff(np.append(first, len(at)))  # of each hash in each row
        many = windows_ * (b - a)[first] > MANY
        few = np.flatnonzero(~np.repeat(many, windows_))
        n = (b - a)[few]
        entry = spans(a[few], n)
        each = (index.item[entry] + len(index.ids) * np.repeat(row[few], n)) * size + np.repeat(at[few], n) - index.at[entry] + base
        each, count = np.unique(each, return_counts=True)
        keys.append(each)
        counts.append(count)
        for k in np.flatnonzero(many):
            i = first[k]
            items, at_items = index.item[a[i] : b[i]], index.at[a[i] : b[i]]
            for item in np.unique(items):
                diagonal, count = differences(at[i : i + windows_[k]], at_items[items == item])
                keys.append((item + len(index.ids) * row[i]) * size + diagonal + base)
                counts.append(count)
    key, of = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    hits = np.bincount(of, np.concatenate(counts), len(key)).astype(np.int64) if keys else key
    pair, diagonal = key // size, key % size - base
    order = np.lexsort((diagonal, -hits, pair))
    return np.stack([pair // max(len(index.ids), 1), pair % max(len(index.ids), 1), diagonal, hits], 1)[order]


def leaks(index: Index, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, first token, end, equal tokens): the best alignment of each item in each text."""
    w, h = tokens(texts)
    found = diagonals(index, w, h)
    if not len(found):
        return []
    pair = found[:, 0] * len(index.ids) + found[:, 1]
    new = np.concatenate([[True], pair[1:] != pair[:-1]])
    group = np.cumsum(new) - 1
    rank = np.arange(len(found)) - np.flatnonzero(new)[group]
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    done = np.zeros(int(group[-1]) + 1, bool)
    low, high = 0, FIRST
    while low <= rank.max():
        for at in _parts(np.flatnonzero((rank >= low) & (rank < high) & ~done[group]), np.diff(index.of)[found[:, 1]]):
            _verify(index, w, h, found[at], group[at], best, done)
        low, high = high, 4 * high
    return [(row, item, *x[:2], x[2]) for (row, item), x in sorted(best.items())]


def _parts(at: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The given positions in parts of about COMPARED tokens."""
    part = np.cumsum(size[at]) // COMPARED
    for k in range(int(part[-1]) + 1 if len(at) else 0):
        yield at[part == k]


def _verify(index: Index, w: Words, h: np.ndarray, found: np.ndarray, group: np.ndarray, best: dict, done: np.ndarray) -> None:
    if not len(found):
        return
    row, item, diagonal, _ = found.T
    n = np.diff(index.of)[item]
    a, b = np.maximum(diagonal, w.of[row]), np.minimum(diagonal + n, w.of[row + 1])
    size = b - a  # a hit lies in it, so it isn't empty
    equal = h[spans(a, size)] == index.tokens[spans(index.of[item] + a - diagonal, size)]
    end = np.cumsum(size)
    total = np.add.reduceat(equal, end - size)
    least = np.array([min(LEAST, needed(k)) if k >= SPAN else needed(k) for k in range(int(n.max()) + 1)])
    for i in np.flatnonzero(total >= least[n]):
        key = (int(row[i]), int(item[i]))
        if total[i] < best.get(key, (0, 0, 0, 0))[2]:
            continue
        if got := verdict(equal[end[i] - size[i] : end[i]], int(n[i]), int(w.of[row[i] + 1] - w.of[row[i]])):
            start = int(a[i] - w.of[row[i]])
            new = (start + got[0], start + got[1], got[2], int(diagonal[i]))
            old = best.get(key)
            if old is None or (-new[2], new[3]) < (-old[2], old[3]):
                best[key] = new
            done[group[i]] |= got[2] == n[i]


def chunks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over parts of benchmark(item_id, text) of at most CHUNK_TOKENS tokens (a longer item is one part)."""
    rows = pick(benchmark, "item_id", "text").filter("item_id is not null and length(text) > 0").orderBy("item_id", "text")
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in rows.toLocalIterator():
        n = len(tokens(pa.array([r[1]]))[0].starts)
        if ids and size + n > CHUNK_TOKENS:
            yield Index.build(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(int(r[0]))
        texts.append(r[1])
        size += n
    if ids:
        yield Index.build(ids, texts)


def _each_chunk(benchmark: DataFrame, step: Callable[[Broadcast], DataFrame], name: str) -> Iterator[DataFrame]:
    """What ``step`` makes of each chunk's index. Where there are several, it is written, and the index is given up before the next."""
    spark = benchmark.sparkSession
    parts = chunks(benchmark)
    index = next(parts, None)
    while index is not None:
        sent = spark.sparkContext.broadcast(index)
        index = next(parts, None)
        out = step(sent)
        if index is None:
            yield out
        else:
            yield stored(out, name)
            sent.destroy()


SCHEMA = "doc_id long, item_id long, first_token long, end_token long, equal_tokens long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and test item of which it holds a passage: SCHEMA.

    Null texts and items hold nothing; null doc_ids are reported as null; repeated
    rows are reported each. An empty benchmark or table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def step(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, texts in pieces(batch.column(1)):
                    if got := leaks(sent.value, texts):
                        row, item, first, end, same = zip(*got, strict=True)
                        doc_ids = batch.column(0).slice(a, len(texts)).take(pa.array(row, pa.int64()))
                        items = pa.array([sent.value.ids[i] for i in item], pa.int64())
                        yield pa.RecordBatch.from_arrays([doc_ids, items, *[pa.array(x, pa.int64()) for x in (first, end, same)]], [c.split()[0] for c in SCHEMA.split(", ")])

        return docs.mapInArrow(run, SCHEMA)

    parts = list(_each_chunk(benchmark, step, "leaks"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark, with all their columns as they were, whatever their names."""
    ship(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")
    left = [numbered(docs)]

    def step(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, texts in pieces(batch.column(at)):
                    bad = {row for row, *_ in leaks(sent.value, texts)}
                    yield batch.slice(a, len(texts)).filter(pa.array([i not in bad for i in range(len(texts))]))

        return left[-1].mapInArrow(run, left[-1].schema)

    for part in _each_chunk(benchmark, step, "clean"):
        left.append(part)
    return left[-1].toDF(*names)
