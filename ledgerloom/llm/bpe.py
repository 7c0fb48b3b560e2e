"""Byte-level BPE encoding and decoding with forced boundaries.

A merge can only join two bytes that stand side by side inside some vocabulary
token. A byte pair that occurs in none is a certain cut: encoding the fragments on
both sides independently and concatenating equals encoding the whole. Texts are cut
into units before white space and between an ASCII letter and a punctuation mark (no
pre-token of the pattern spans either), new units by the pre-token pattern, then at
forced boundaries; fragments are encoded by the vocabulary's own merges. What units
and fragments were encoded to is remembered under their bytes, in tables of bounded size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import pick, ship
from ._text import SPACE, buffer, pieces
from ._units import IdTable, Memory, alone, spans

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of memory for fragments, and the longest fragment that is remembered.
REMEMBERED, LONGEST = 32 << 20, 64
#: Units of new text that are cut at a time: bounds the fragments held at once.
CUT = 1 << 16
#: ASCII classes: letters; punctuation marks but the apostrophe; controls that count as white space nowhere or not everywhere.
LETTER, MARK, CONTROL = (np.zeros(256, bool) for _ in range(3))
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
CONTROL[0x1C:0x20] = True


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible, else one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in visible else chr(spare))
        spare += b not in visible
    return out


def check(spec: dict) -> None:
    """Refuse a vocabulary file that the cuts of this module don't hold for."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = [
        what
        for what, wrong in (
            ("a normalizer", spec.get("normalizer")),
            ("no byte-level pre-tokenizer with its own pattern", before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)),
            ("no plain BPE model", model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")),
            ("affixes of subwords", model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")),
            ("added tokens that take in what stands beside them", any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))),
        )
        if wrong
    ]
    if odd:
        raise ValueError(f"this vocabulary has {', '.join(odd)}")


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file (JSON of the tokenizers library)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        self.tokens = {i: bytes(back[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        self.inside = bytearray(1 << 16)  # byte pairs that some token holds
        for t in self.tokens.values():
            for a, b in zip(t, t[1:], strict=False):
                self.inside[a << 8 | b] = 1
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens |= {i: s.encode() for s, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merger = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "pre_tokenizer": None, "normalizer": None, "post_processor": None}))
        self.pretokens = regex.compile(PATTERN).findall
        self.fragments = Memory(REMEMBERED)
        self.table = IdTable(self._units)
        self.size = np.zeros(max(self.tokens) + 1, np.int64)
        for i, t in self.tokens.items():
            self.size[i] = len(t)
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(self.size))), np.uint8)

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments of a pre-token between its forced boundaries."""
        out, start = [], 0
        for i in range(1, len(word)):
            if not self.inside[word[i - 1] << 8 | word[i]]:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _units(self, units: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        at = 0
        while at < len(units):
            end, size = at, 0
            while end < len(units) and (end == at or size + len(units[end]) <= CUT):
                size += len(units[end])
                end += 1
            out += self._some(units[at:end])
            at = end
        return out

    def _some(self, units: list[bytes]) -> list[list[int]]:
        cut = [[f for w in self.pretokens(u.decode()) for f in self.cuts(w.encode())] for u in units]
        held = {f: self.fragments.get(f) for f in {f for c in cut for f in c}}
        missing = [f for f, ids in held.items() if ids is None]
        letters = self.letters.__getitem__
        for i in range(0, len(missing), 8192):
            part = missing[i : i + 8192]
            for f, e in zip(part, self.merger.encode_batch_fast(["".join(map(letters, f)) for f in part], add_special_tokens=False), strict=True):
                held[f] = np.array(e.ids, np.int32).tobytes()
                if len(f) <= LONGEST:
                    self.fragments.put(f, held[f])
        return [np.frombuffer(b"".join(map(held.__getitem__, c)), np.int32).tolist() for c in cut]

    def _whole(self, text: str) -> list[int]:
        """A text that holds special tokens: these stand for themselves, what is between is encoded alone."""
        parts = self.specials.split(text)
        return [i for k, x in enumerate(parts) for i in ([self.special[x]] if k % 2 else self.encode(pa.array([x]))[0].tolist())]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        data, offs = buffer(texts)
        n = len(data)
        if self.specials and any(data.tobytes().find(s.encode()) >= 0 for s in self.special):
            held = [t or "" for t in texts.to_pylist()]
            each = [np.array(self._whole(t), np.int32) if self.specials.search(t) else self.encode(pa.array([t]))[0] for t in held]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        begin = np.zeros(n + 1, bool)
        begin[1:n] = (SPACE[data[1:]] & ~(SPACE | CONTROL)[data[:-1]]) | (LETTER[data[:-1]] & MARK[data[1:]])
        wide = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3) & (data[1:-1] <= 0x9A)) + 3 if n > 2 else np.zeros(0, int)
        begin[wide[wide < n]] = False  # after what may be white space beyond ASCII
        two = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))) + 2
        begin[two] = False
        begin[offs] = True
        starts = np.flatnonzero(begin[:n])
        ends = np.append(starts[1:], n)
        ids, lengths = self.table.ids(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[np.searchsorted(starts, offs)])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The text of each list of ids; unknown ids are left out, bytes that aren't UTF-8 become U+FFFD."""
        known = (ids >= 0) & (ids < len(self.size))
        size = np.where(known, self.size[np.where(known, ids, 0)], 0)
        first = np.cumsum(self.size) - self.size
        raw = self.bytes[spans(first[np.where(known, ids, 0)], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBPE:
    alone()
    return ForcedBoundaryBPE(path)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", decoded: str | None = None) -> DataFrame:
    """The kept columns and ``ids array<int>`` of every row; a null text counts as empty: no ids.

    ``decoded`` names a column for the text decoded from the ids by the same worker,
    which spares a second one per task. Rows stay as they are: repeated and null ids
    too. Other columns are dropped, so that none can clash with ``ids``.
    """
    ship(docs.sparkSession)
    docs = pick(docs, *keep, text)
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            for a, texts in pieces(batch.column(len(keep)), 1 << 21):
                ids, lengths = coder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                arrays = [batch.column(i).slice(a, len(texts)) for i in range(len(keep))]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))
                if decoded:
                    arrays.append(pa.array(coder.decode(ids, lengths), pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, out: str = "decoded") -> DataFrame:
    """``coded`` with its ids decoded into the column ``out``; a null list gives the empty text."""
    ship(coded.sparkSession)
    schema = T.StructType([*coded.schema.fields, T.StructField(out, T.StringType())])
    at = coded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(at)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                texts = pa.array(coder.decode(ids, lengths), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, out])

    return coded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text)."""
    return encode(docs, path, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
