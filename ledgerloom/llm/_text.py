"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 buffer of an Arrow string column, so the cost per
document is a few numpy passes and no Python object is made per word. Long
buffers are walked in pieces of about a megabyte, which bounds memory whatever
the batch or document size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Space and the five ASCII controls \t \n \v \f \r: the separators of every contract here.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Separators of the alphanumeric word mode: every ASCII byte but letters and digits.
PUNCT = np.ones(256, bool)
PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: ASCII lower-casing of single bytes.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32

_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of uint64 with full avalanche."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x ^ (x >> _U(31)) ^ (x >> _U(62))
    x = x * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> _U(27)) ^ (x >> _U(54))
    x = x * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> _U(30)) ^ (x >> _U(60))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 0x2545F4914F6CDD1D % 2**64)) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        n = max(n, PIECE + 4096)
        have = np.full(n, base, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of slices of about ``most`` bytes of text, each of one row at least."""
    _, offs = buffer(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, column.slice(a, b - a)
        a = b


class Words:
    """Words of a batch of texts: ``starts``/``ends`` in ``data`` and ``of`` (word offsets per text)."""

    __slots__ = ("data", "ends", "of", "offs", "starts")

    def __init__(self, data: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE):
        inside = ~separators[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offs] = True  # a text begins here
        begin, end = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1] | first[1:n]
            end[:-1] &= ~inside[1:] | first[1:n]
        self.data, self.offs = data, offs
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.of = np.searchsorted(self.starts, offs)

    @classmethod
    def of_column(cls, column: pa.Array, separators: np.ndarray = SPACE) -> Words:
        return cls(*buffer(column), separators)

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.of) - 1), self.counts())

    def hashes(self, fold: bool = True) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, fold)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each span: a polynomial over a random byte table, then mixed.

    Spans ascend and don't overlap. With prefix sums S and base P, a span's value is
    (S[end] - S[start]) / P**start, whichever piece of the buffer it lies in.
    """
    out = np.empty(len(starts), np.uint64)
    table = _TABLE[FOLD] if fold else _TABLE
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        part = data[base : int(ends[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * _powers(_BASE, len(part))[: len(part)], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * _powers(_INVERSE, len(part) + 1)[a]
        i = j
    return mix(out)


def windows(hashes: np.ndarray, of: np.ndarray, k: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of k words that stays within one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = constants(k, seed)
    x = hashes[:n] * c[0]
    for j in range(1, k):
        x += hashes[j : j + n] * c[j]
    fits = np.ones(n, bool)
    for e in of[1:-1]:  # windows over a text's end
        fits[max(0, e - k + 1) : min(n, e)] = False
    at = np.flatnonzero(fits)
    return mix(x[at]), at
