"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and 60 bits of equally wide values, as many as
fit; selector 15 escapes: the next word is one whole 64-bit value. Ids are cut into
blocks of BLOCK, each starting at a word of its own, so a table of word offsets lets
a reader start at any block and decode all words of a selector in one numpy step.

A shard's bytes: magic, counts (documents, ids, words) as u64, then doc ids (i64),
a bitmap byte per document for null ids, lengths (u64), block offsets (u64, one more
than blocks), words (u64), and the CRC-32 of all of it. Shards are rows of a Parquet
table (any store that Spark writes to), in ascending order of (part, seq).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import fresh, pick, ship
from ._text import FOLD, Words, pieces
from ._units import IdTable, alone

MAGIC = b"LLS8B\0\0\1"
BLOCK = 1024
SHARD_IDS = 1 << 20
#: Bytes of input files for one writer task.
TASK_BYTES = 256 << 20
#: part: the writer's task; before: ids in the part's shards before this one.
SHARDS = "part int, seq int, before long, n_ids long, data binary"
#: ASCII letters, and marks that no pre-token shares with a letter.
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
#: Values per word and bits per value of each selector; 15 is the escape.
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
_U = np.uint64


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end) of unsigned 64-bit values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + 60), np.uint64)  # padded: what is past the end fits any width
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = values
    grid[:, :BLOCK] = full.reshape(blocks, BLOCK)
    choice = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    bits_of = np.frexp((grid >> _U(32)).astype(np.float64))[1] + 32  # exact bit lengths, by halves
    low = grid < _U(1 << 32)
    bits_of[low] = np.frexp(grid[low].astype(np.float64))[1]
    bits_of = bits_of.astype(np.uint8)
    seen = np.zeros((blocks, BLOCK + 61), np.uint16)
    for s in range(len(LAYOUT) - 1, -1, -1):
        count, bits = LAYOUT[s]
        np.cumsum(bits_of > bits, axis=1, dtype=np.uint16, out=seen[:, 1:])
        choice[seen[:, count : count + BLOCK] == seen[:, :BLOCK]] = s
    counts = np.array([c for c, _ in LAYOUT] + [0, 1], np.int64)
    size = np.full(blocks, BLOCK)
    if blocks:
        size[-1] = n - (blocks - 1) * BLOCK
    row, pos, steps = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(row):  # one word of every block at a time
        s = choice[row, pos]
        steps.append((row, pos, s))
        pos = pos + counts[s]
        on = pos < size[row]
        row, pos = row[on], pos[on]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    row, pos, s = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.lexsort((pos, row))
    row, pos, s = row[order], pos[order], s[order]
    width = 1 + (s == ESCAPE).astype(np.int64)
    start = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for k, (count, bits) in enumerate(LAYOUT):
        at = np.flatnonzero(s == k)
        if len(at):
            part = grid[row[at, None], pos[at, None] + np.arange(count)]
            shift = (np.arange(count) * bits + 4).astype(np.uint64)
            words[start[at]] = np.bitwise_or.reduce(part << shift, axis=1) | _U(k)
    at = np.flatnonzero(s == ESCAPE)
    words[start[at]] = ESCAPE
    words[start[at] + 1] = grid[row[at], pos[at]]
    offsets = np.concatenate([start[np.searchsorted(row, np.arange(blocks))], [len(words)]])
    return words, offsets.astype(np.uint64)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of blocks whose words start at ``offsets``."""
    out = np.zeros(n + 64, np.uint64)
    selector = (words & _U(15)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    for i in np.flatnonzero(selector == ESCAPE):  # rare: a raw word may look like an escape itself
        raw[i + 1] |= not raw[i]
    raw = raw[:-1]
    counts = np.array([c for c, _ in LAYOUT] + [0, 1], np.int64)[selector]
    counts[raw] = 0
    block = np.searchsorted(offsets[1:], np.arange(len(words)), "right")
    before = np.cumsum(counts) - counts
    first = before[offsets[:-1].astype(np.int64)] if len(words) else before
    pos = before - first[block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for k, (count, bits) in enumerate(LAYOUT):
        at = np.flatnonzero((selector == k) & ~raw)
        if len(at):
            shift = (np.arange(count) * bits + 4).astype(np.uint64)
            values = (words[at, None] >> shift) & _U((1 << bits) - 1)
            where = pos[at, None] + np.arange(count)
            fits = where < end[at, None]
            out[where[fits]] = values[fits]
    at = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[pos[at]] = words[at + 1] if len(at) else 0
    return out[:n]


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = pack(ids.astype(np.uint64))
    head = np.array([len(doc_ids), len(ids), len(words)], np.uint64)
    body = MAGIC + b"".join(
        [
            head.tobytes(),
            np.array([d or 0 for d in doc_ids], np.int64).tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            lengths.astype(np.uint64).tobytes(),
            offsets.tobytes(),
            words.tobytes(),
        ]
    )
    return body + zlib.crc32(body).to_bytes(4, "little")


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a shard; a damaged one raises ValueError."""
    if data[:8] != MAGIC or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("not a token shard, or a damaged one")
    n, total, n_words = map(int, np.frombuffer(data, np.uint64, 3, 8))
    at = 32
    doc_ids = np.frombuffer(data, np.int64, n, at).tolist()
    null = np.frombuffer(data, np.uint8, n, at + 8 * n)
    lengths = np.frombuffer(data, np.uint64, n, at + 9 * n).astype(np.int64)
    blocks = -(-total // BLOCK)
    offsets = np.frombuffer(data, np.uint64, blocks + 1, at + 17 * n)
    words = np.frombuffer(data, np.uint64, n_words, at + 17 * n + 8 * (blocks + 1))
    return [None if z else d for d, z in zip(doc_ids, null, strict=True)], lengths, unpack(words, offsets, total)


def check(spec: dict) -> None:
    """Refuse a vocabulary file that the cuts of this module don't hold for."""

    def kinds(x: dict | None, inner: str) -> list[str]:
        return [k for y in x.get(inner, []) for k in kinds(y, inner)] or [x["type"]] if x else []

    lower = [k for k in kinds(spec.get("normalizer"), "normalizers") if k != "Replace"]
    before = kinds(spec.get("pre_tokenizer"), "pretokenizers")
    split = next((x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"), {})
    beside = any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
    if lower != ["NFC", "Lowercase"] or before != ["Split", "ByteLevel"] or (split["behavior"], split["invert"]) != ("Removed", True) or beside or spec["model"].get("dropout") or spec["model"].get("end_of_word_suffix") != "</w>":
        raise ValueError("this vocabulary doesn't fold case, drop white space and keep letters and marks apart, or its added tokens take in what stands beside them")


class Tokens:
    """Ids as the tokenizers library makes them with add_special_tokens=False, a batch at once.

    For vocabularies that drop white space and fold case (NFC, lower case, then runs
    of letters, single digits and runs of marks). A text is cut at ASCII white space
    and between ASCII letters and marks (not at an apostrophe, which may begin a
    contraction); the library encodes each distinct piece once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        check(json.loads(self.tokenizer.to_str()))
        self.table = IdTable(self._units)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a pre-token
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")

    def _units(self, units: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(units)
        word = [u.isalpha() for u in units]  # ASCII letters: one pre-token each
        self._words(units, [i for i, w in enumerate(word) if w], out)
        rest = [i for i, w in enumerate(word) if not w]
        for a in range(0, len(rest), 8192):
            part = rest[a : a + 8192]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([units[i].decode() for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _words(self, units: list[bytes], at: list[int], out: list[list[int]]) -> None:
        """Words are encoded many at a time, and their ids cut after each that ends a word."""
        for a in range(0, len(at), 4096):
            part = at[a : a + 4096]
            ids = self.tokenizer.encode_batch_fast([b" ".join([units[i] for i in part]).decode()], add_special_tokens=False)[0].ids
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            for i, x, y in zip(part, [0, *ends], ends, strict=False):
                out[i] = ids[x:y]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        words = Words.of_column(texts)
        data, starts, ends = words.data, words.starts, words.ends
        raw = data.tobytes()
        special = any(raw.find(s) >= 0 for s in self.special)
        if not special and len(data):
            cut = np.zeros(len(data) + 1, bool)
            cut[1:-1] = (LETTER[data[:-1]] & MARK[data[1:]]) | (MARK[data[:-1]] & LETTER[data[1:]])
            cut[words.offs] = False
            at = np.flatnonzero(cut)
            starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
        # the texts' special tokens are case-sensitive, and may hold marks
        ids, lengths = self.table.ids(data if special else FOLD[data], starts, ends)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[np.searchsorted(starts, words.offs)])


@lru_cache(maxsize=2)
def load(path: str) -> Tokens:
    alone()
    return Tokens(path)


def _shards(path: str, end: int):
    """Sorted rows (part, doc_id, text) of one partition -> shards of about SHARD_IDS ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        seq, before, part = 0, 0, None

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, sizes, seq, before
            ids = np.concatenate(held)
            data = write_shard(docs, np.concatenate(sizes), ids)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())]
            docs, held, sizes, seq, before = [], [], [], seq + 1, before + len(ids)
            return pa.RecordBatch.from_arrays(row, ["part", "seq", "before", "n_ids", "data"])

        for batch in batches:
            part = batch.column(0)[0].as_py() if batch.num_rows else part
            for a, texts in pieces(batch.column(2)):
                ids, lengths = coder.encode(texts)
                ids = np.insert(ids, np.cumsum(lengths), end)  # after each document's ids
                docs += batch.column(1).slice(a, len(texts)).to_pylist()
                held.append(ids)
                sizes.append(lengths + 1)
                if sum(map(len, held)) >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, to: str, end: int = 2) -> None:
    """Encode docs(doc_id, text), append ``end`` to each, and write shards in ascending doc_id order.

    Null texts count as empty, null doc_ids come first, rows of one doc_id stand in
    the order of their texts; an empty table writes no shard.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # as many tasks as the size of the input asks for; rows of one id are dealt by the beginnings of their texts
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // TASK_BYTES), 1)
    order = F.col("doc_id").asc_nulls_first()
    ranged = docs.repartitionByRange(n, order, F.substring("text", 1, 16)).sortWithinPartitions(order, "text")
    shards = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_shards(path, end), SHARDS)
    shards.write.parquet(to)


def input_bytes(df: DataFrame) -> int:
    """What the optimizer takes the size of df to be, from the sizes of its files; 0 if it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, ids (u32 bytes) of every document of the shards under ``path``."""
    ship(spark)
    shards = spark.read.schema(SHARDS).parquet(path)
    # a row a partition comes to the driver and goes to all tasks: as many as the writer had tasks
    totals = sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids")).collect()))
    base, offsets = 0, []
    for part, n in totals:
        offsets.append((part, base))
        base += n
    at = F.broadcast(spark.createDataFrame(offsets, "part int, base long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(*(batch.column(c).to_pylist() for c in ("start", "data")), strict=True):
                docs, lengths, ids = read_shard(data)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                rows = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + ends - lengths, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "start", "ids"])

    return shards.join(at, "part").select((F.col("base") + F.col("before")).alias("start"), "data").mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files written."""
    spark = docs.sparkSession
    to = fresh(spark, "tokens")
    write_tokens(docs, path, to)
    return read_tokens(spark, to).select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
