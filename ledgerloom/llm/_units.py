"""Ids of recurring text units, looked up for a whole batch at once.

The units of a batch are told apart by their bytes, by Arrow's dictionary encoding. In
the table of those seen before, a unit is found by a hash and then compared byte by
byte, all units of a batch at once, so two units of one hash are never confused: the one
that came later is encoded each time. What is remembered is bounded in bytes; units
that are too long to recur aren't remembered.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ._text import span_hashes


def alone() -> None:
    """Let the tokenizers library use one thread in this process: the cores have a task each already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each span, one span after the other."""
    ends = np.cumsum(lengths)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    return out + np.repeat(starts - (ends - lengths), lengths)


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span of ``data``; spans ascend and don't overlap."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    if int(offsets[-1]) != len(data):  # what lies between spans goes
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts] = 1
        edge[ends] -= 1
        data = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class _Pool:
    """Arrays one after the other, and where each begins."""

    def __init__(self, dtype: type):
        self.starts, self.lengths, self.data = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)

    def add(self, lengths: np.ndarray, data: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, np.cumsum(lengths) - lengths + len(self.data)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.data = np.concatenate([self.data, data])

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.data[spans(self.starts[at], self.lengths[at])]

    @property
    def nbytes(self) -> int:
        return self.starts.nbytes + self.lengths.nbytes + self.data.nbytes


class _Level:
    def __init__(self) -> None:
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.units, self.ids = _Pool(np.uint8), _Pool(np.int32)

    def add(self, hashes: np.ndarray, lengths: np.ndarray, data: np.ndarray, n_ids: np.ndarray, ids: np.ndarray) -> None:
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.order = np.concatenate([self.order, np.arange(len(self.order), len(hashes))])[order]
        self.units.add(lengths, data)
        self.ids.add(n_ids, ids)

    def find(self, hashes: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(units that are here, where): of equal hash, length and bytes."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        where = self.order[at]
        some = np.flatnonzero((self.hashes[at] == hashes) & (self.units.lengths[where] == lengths))
        n = lengths[some]
        starts = np.cumsum(lengths) - lengths
        other = data[spans(starts[some], n)] != self.units.get(where[some])
        wrong = np.add.reduceat(other, np.cumsum(n) - n) if len(some) else other
        some = some[wrong == 0]
        return some, where[some]

    @property
    def nbytes(self) -> int:
        return self.hashes.nbytes + self.order.nbytes + self.units.nbytes + self.ids.nbytes


class IdTable:
    """encode: the ids of each of a list of distinct units, none of which is empty.

    The table takes about ``most`` bytes: beyond half of it, the older part goes. Units of over ``longest`` bytes aren't remembered.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 96 << 20, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.old, self.new = _Level(), _Level()

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, number of ids of each unit)."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = units(data, starts, ends).dictionary_encode()
        of, distinct = coded.indices.to_numpy(), coded.dictionary
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        raw = np.frombuffer(distinct.buffers()[2], np.uint8)[: int(offsets[-1])]
        lengths = np.diff(offsets)
        hashes = span_hashes(raw, offsets[:-1], offsets[1:], fold=False)
        size = np.zeros(len(distinct), np.int64)
        unknown = np.ones(len(distinct), bool)
        found = []
        for level in (self.old, self.new):
            here, where = level.find(hashes, lengths, raw)
            here, where = here[unknown[here]], where[unknown[here]]
            unknown[here] = False
            size[here] = level.ids.lengths[where]
            found.append((here, level.ids.get(where)))
        missing = np.flatnonzero(unknown)
        if len(missing):
            coded_now = self.encode(distinct.take(pa.array(missing)).to_pylist())
            n = np.fromiter(map(len, coded_now), np.int64, len(coded_now))
            ids = np.fromiter((i for x in coded_now for i in x), np.int32, int(n.sum()))
            size[missing] = n
            found.append((missing, ids))
            short = lengths[missing] <= self.longest
            kept = missing[short]
            self.new.add(hashes[kept], lengths[kept], raw[spans(offsets[kept], lengths[kept])], n[short], ids[np.repeat(short, n)])
        pool = np.empty(int(size.sum()), np.int32)
        first = np.cumsum(size) - size
        for here, ids in found:
            pool[spans(first[here], size[here])] = ids
        if len(self.new.hashes) > 20_000 + len(self.old.hashes) // 4 or self.new.nbytes > self.most // 4:
            self._turn()
        lengths = size[of]
        return pool[spans(first[of], lengths)], lengths

    def _turn(self) -> None:
        if self.old.nbytes + self.new.nbytes > self.most // 2:
            self.old = _Level()
        new, every = self.new, np.arange(len(self.new.hashes))
        hashes = np.empty_like(new.hashes)
        hashes[new.order] = new.hashes
        self.old.add(hashes, new.units.lengths, new.units.get(every), new.ids.lengths, new.ids.get(every))
        self.new = _Level()


class Memory:
    """Ids by unit, of about ``most`` bytes: at half of it, what hasn't been used since the last time goes."""

    #: Bytes of an entry besides those of the unit and of its ids: two objects and their place in the table.
    ENTRY = 200

    def __init__(self, most: int):
        self.half, self.size = most // 2, 0
        self.old: dict[bytes, bytes] = {}
        self.new: dict[bytes, bytes] = {}

    def get(self, key: bytes) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: bytes, value: bytes) -> None:
        self.new[key] = value
        self.size += len(key) + len(value) + self.ENTRY
        if self.size > self.half:
            self.old, self.new, self.size = self.new, {}, 0
