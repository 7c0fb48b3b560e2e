"""Removal of byte strings that an earlier document holds too, by blockwise suffix sorting.

The suffixes of all texts are sorted one bucket at a time; a bucket's suffixes that agree
in LENGTH bytes stand side by side, and all but those of the least doc_id are marked.

1. Documents are cut into chunks of about CHUNK bytes, in a table bucketed by chunk, so
   that texts are read back beside what is found about them without a shuffle of texts.
2. A suffix belongs to the bucket of the least hashed GRAM-byte string within its LENGTH
   bytes: suffixes that agree in LENGTH bytes share it wherever they stand. Neighbours
   mostly share it as well and travel as one record of at most RUN suffixes and
   RUN + LENGTH - 1 bytes.
3. Only the hashes of these strings are dealt out first, once a chunk. What one document
   alone holds goes no further: its suffixes agree with no others.
4. Records of all others are dealt to their buckets, equal ones of a chunk once. A string
   that stands in more than HOT different records has its suffixes dealt one by one, by
   their LENGTH bytes, so no string makes a bucket large.
5. Each bucket folds equal records and sorts its suffixes slice by slice: ranks of the
   positions of a difference cover modulo PERIOD are made first, by doubling; suffixes are
   sorted by PERIOD bytes, and ties among them by the ranks at the nearest distance at
   which both stand on the cover. Neighbours in this order are compared byte by byte, so
   no hash decides what is equal.
6. Marks go back to the chunks, where bytes are removed.

Memory is a chunk's, or a slice's; what is shuffled is in proportion to the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, fresh, pick, ship, stored
from ._text import buffer, constants, mix

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
RUN = 32
CHUNK, SEGMENT = 4 << 20, 1 << 19
#: Bytes of text for each bucket.
BUCKET = 16 << 20
HOT, SLICE = 4096, 16_384
#: Any two residues modulo PERIOD stand on COVER at some common distance.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Rows of a slice: a record's least string stands at column WINDOW, whatever it is.
WIDTH = 128
_U = np.uint64

DISTANCE = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
ON_COVER = np.isin(np.arange(WIDTH) % PERIOD, COVER)


def _words(data: np.ndarray, kind: str) -> np.ndarray:
    """The 8 bytes from each place on, of data with 8 bytes to spare."""
    return np.ndarray((len(data) - 7,), kind, data, strides=(1,))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = _words(data, "<u8").astype(np.uint64)
    c = constants(3, 41)
    x = w[:n] * c[0]
    x ^= x >> _U(29)
    x += w[8 : 8 + n] * c[1]
    x ^= x >> _U(31)
    x += w[12 : 12 + n] * c[2]
    x ^= x >> _U(32)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(29)
    return x


def least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


class Records:
    """Runs of suffixes with one least string: ``start`` in the chunk, ``run`` (suffixes), ``key`` (that string's hash)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, use: np.ndarray):
        """Texts are data[offs[i]:offs[i+1]]; those with use[i] false have no records."""
        start, run, key = [], [], []
        for a in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
            b = min(a + SEGMENT, len(data) - LENGTH + 1)
            low = least(gram_hashes(data[a : b + LENGTH - 1]), WINDOW)
            inside = np.ones(b - a, bool)
            i, j = np.searchsorted(offs, a, "right") - 1, np.searchsorted(offs, b + LENGTH, "left")
            for t in range(int(i), min(int(j) + 1, len(use))):
                e = int(offs[t + 1])
                inside[max(0, (e - LENGTH + 1 if use[t] else int(offs[t])) - a) : max(0, e - a)] = False
            new = inside.copy()
            new[1:] &= ~inside[:-1] | (low[1:] != low[:-1])
            at = np.flatnonzero(new)
            if not len(at):
                continue
            stop = inside & ~np.append(inside[1:], False) | np.append(new[1:], False) & inside
            n = np.flatnonzero(stop) - at + 1
            parts = (n + RUN - 1) // RUN  # longer ones, of repetitive text, are cut
            whole = np.repeat(at, parts)
            step = (np.arange(len(whole)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
            start.append(a + whole + step)
            run.append(np.minimum(RUN, np.repeat(n, parts) - step))
            key.append(mix(low[whole]))
        join = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
        self.start, self.run, self.key = join(start, np.int64), join(run, np.int64), join(key, np.uint64)


def contents(words: np.ndarray, start: np.ndarray, run: np.ndarray) -> np.ndarray:
    """A hash of each record's bytes."""
    c = constants(14, 42)
    x = run.astype(np.uint64)
    for i, at in enumerate((start, start + run - 1)):
        for j, o in enumerate((0, 8, 16, 24, 32, 40, 42)):
            x = (x + words[at + o]) * c[7 * i + j]
            x ^= x >> _U(32)
    return x


def ordered(key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key and content, where another one begins)."""
    order = np.lexsort((content, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
    return order, new


def _chunk(table: pa.Table):
    """(data, offs, ids, use, spare) of a chunk's rows in their order; spare is the data with 8 more bytes."""
    table = table.sort_by("pos")
    ids = table.column("doc_id").combine_chunks()
    data, offs = buffer(table.column("text"))
    spare = np.zeros(len(data) + 8, np.uint8)
    spare[: len(data)] = data
    use = ids.is_valid().to_numpy(zero_copy_only=False)
    return table, spare[: len(data)], offs, ids.fill_null(0).to_numpy(zero_copy_only=False), use, spare


def _strings(bits: int):
    """A chunk -> for each bucket the hashes (48 bits) of its least strings, the number of records of each, and whether two documents have it."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, data, offs, ids, use, spare = _chunk(table)
        r = Records(data, offs, use)
        if not len(r.key):
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "strings": pa.array([], pa.binary())})
        order, new = ordered(r.key, contents(_words(spare, "<u8"), r.start, r.run))
        key = r.key[order] >> _U(16)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        doc = ids[np.searchsorted(offs, r.start[order], "right") - 1]
        several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        n = np.minimum(np.add.reduceat(new.astype(np.int64), first), (1 << 15) - 1)
        entries = key[first] << _U(16) | (n << 1).astype(np.uint64) | several.astype(np.uint64)
        bucket = (key[first] >> _U(48 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(cut[1:], len(bucket))
        return pa.table({"bucket": bucket[cut], "chunk": np.full(len(cut), chunk), "strings": pa.array([entries[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())})

    return run


def _judged(table: pa.Table) -> pa.Table:
    """One bucket's strings from all chunks -> for each chunk and string: 0 one document alone has it, 1 several have, 2 it is hot."""
    raw = table.column("strings").to_pylist()
    entries = np.frombuffer(b"".join(raw), np.uint64)
    _, of, chunks = np.unique(entries >> _U(16), return_inverse=True, return_counts=True)
    n = np.bincount(of, (entries >> _U(1) & _U(0x7FFF)).astype(np.float64))
    several = np.bincount(of, (entries & _U(1)).astype(np.float64)) > 0
    verdict = np.where(several | (chunks > 1), np.where(n > HOT, 2, 1), 0).astype(np.uint8)[of]
    ends = np.cumsum([len(x) // 8 for x in raw])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "verdicts": pa.array([verdict[e - len(x) // 8 : e].tobytes() for e, x in zip(ends, raw, strict=True)], pa.binary())})


RECORDS = "bucket long, chunk long, keys binary, runs binary, leads binary, docs binary, counts binary, at binary, bytes binary, marks binary"


def _records(bits: int):
    """A chunk and its strings' verdicts -> for each bucket the records to sort; ``marks`` are windows that the chunk alone settles."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        out = {n: [] for n in names}
        if table.num_rows and verdicts.num_rows:
            chunk = table.column("chunk")[0].as_py()
            _, data, offs, ids, use, spare = _chunk(table)
            words = _words(spare, "<u8")
            r = Records(data, offs, use)
            verdict = np.frombuffer(b"".join(verdicts.sort_by("bucket").column("verdicts").to_pylist()), np.uint8)
            _, of = np.unique(r.key >> _U(16), return_inverse=True)
            verdict = verdict[of]
            one, hot = verdict == 1, np.flatnonzero(verdict == 2)
            each = np.repeat(r.start[hot], r.run[hot]) + np.arange(int(r.run[hot].sum())) - np.repeat(np.cumsum(r.run[hot]) - r.run[hot], r.run[hot])
            start, n = np.append(r.start[one], each), np.append(r.run[one], np.ones(len(each), np.int64))
            content = contents(words, start, n)
            key = np.append(r.key[one], mix(content[int(one.sum()) :]))
            order, new = ordered(key, content)
            start, n, key = start[order], n[order], key[order]
            doc = ids[np.searchsorted(offs, start, "right") - 1]
            first = np.flatnonzero(new)
            if len(first):
                group = np.cumsum(new) - 1
                lowest = np.minimum.reduceat(doc, first)
                own = doc == lowest[group]
                settled = start[~own], (1 << n[~own]) - 1
                _pack(out, names, bits, chunk, data, start[first], n[first], key[first], lowest, np.bincount(group[own], minlength=len(first)), start[own])
                if len(settled[0]):
                    row = dict.fromkeys(names, b"") | {"bucket": chunk * 0x9E3779B1 % (1 << bits), "chunk": chunk, "marks": np.stack(settled).astype(np.uint32).tobytes()}
                    for c in names:
                        out[c].append(row[c])
        kinds = {c: pa.int64() if c in ("bucket", "chunk") else pa.binary() for c in names}
        return pa.table({c: pa.array(out[c], kinds[c]) for c in names})

    return run


def _pack(out, names, bits, chunk, data, start, n, key, docs, counts, at) -> None:
    """Rows of records, ordered by key, for each bucket."""
    grams = gram_hashes(data)
    leads = np.concatenate([np.zeros(0, np.int64), *[grams[start[i : i + 65536, None] + np.arange(WINDOW)].argmin(1) for i in range(0, len(start), 65536)]])
    bucket = (key >> _U(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    until = np.concatenate([[0], np.cumsum(counts)])
    for i, j in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
        size = n[i:j] + LENGTH - 1
        take = np.repeat(start[i:j] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        row = [int(bucket[i]), chunk, key[i:j], n[i:j].astype(np.uint8), leads[i:j].astype(np.uint8), docs[i:j], counts[i:j].astype(np.uint32), at[until[i] : until[j]].astype(np.uint32), data[take], b""]
        for c, v in zip(names, row, strict=True):
            out[c].append(v.tobytes() if isinstance(v, np.ndarray) else v)


def ranked(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1, of keys compared from the first on."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def cover_ranks(cells: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranks of the cover's positions in rows of bytes, by 4 * PERIOD bytes at least; elsewhere 0.

    Row i has bytes in columns begin[i] to begin[i] + size[i]; what follows counts as zeros.
    """
    column = np.arange(WIDTH)
    on = ON_COVER & (column >= begin[:, None]) & (column < (begin + size)[:, None])
    at = np.flatnonzero(on)
    words = _words(cells, ">u8")
    rank = np.zeros(on.size + 4 * PERIOD, np.int64)
    rank[at] = ranked(words[at].astype(np.uint64), words[at + PERIOD - 8].astype(np.uint64))
    for step in (PERIOD, 2 * PERIOD):
        rank[at] = ranked(rank[at] << 32 | np.where((at % WIDTH) + step < WIDTH, rank[at + step], 0))
    return rank


def suffix_order(cells: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of the suffixes at the places ``at``, in which all that agree in LENGTH bytes are neighbours.

    They are sorted by PERIOD bytes first. Ties that stand at one residue follow the rank
    at the next position on the cover; others get their place among the tied ones of each
    residue by the ranks at the distance at which both stand on the cover.
    """
    rank = cover_ranks(cells, begin, size)
    words = _words(cells, ">u8")
    tied = ranked(words[at].astype(np.uint64), words[at + PERIOD - 8].astype(np.uint64))
    residue = at % WIDTH % PERIOD
    next_ = rank[at + DISTANCE[residue, residue]]
    order = np.argsort((tied << 36) | (residue << 32) | next_, kind="stable")
    group, kind = tied[order], residue[order]
    mixed = np.zeros(int(tied.max(initial=0)) + 1, bool)
    mixed[group[1:][(group[1:] == group[:-1]) & (kind[1:] != kind[:-1])]] = True
    slots = np.flatnonzero(mixed[group])
    if len(slots):
        some = order[slots]
        group, kind = tied[some] << 32, residue[some]
        before = np.zeros(len(some), np.int64)
        of = {a: np.flatnonzero(kind == a) for a in np.unique(kind).tolist()}
        for a, x in of.items():
            for b, y in of.items():
                d = DISTANCE[a, b]
                theirs = np.sort(group[y] | rank[at[some[y]] + d])
                mine = group[x] | rank[at[some[x]] + d]
                before[x] += np.searchsorted(theirs, mine) - np.searchsorted(theirs, group[x])
        order[slots] = some[np.argsort(group | before, kind="stable")]
    return order


def first_documents(cells: np.ndarray, begin: np.ndarray, size: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row's run, least document with the same LENGTH bytes) of every suffix of the rows."""
    run = size - LENGTH + 1
    row = np.repeat(np.arange(len(run)), run)
    place = np.arange(len(row)) - np.repeat(np.cumsum(run) - run, run)
    at = row * WIDTH + begin[row] + place
    order = suffix_order(cells, begin, size, at)
    words, sorted_ = _words(cells, ">u8"), at[order]
    new = np.zeros(len(order), bool)
    for o in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = words[sorted_ + o]
        new[1:] |= w[1:] != w[:-1]
    if len(new):
        new[0] = True
    first = np.empty(len(order), np.int64)
    if len(order):
        heads = np.flatnonzero(new)
        first[order] = np.minimum.reduceat(docs[row[order]], heads)[np.cumsum(new) - 1]
    return row, place, first


def _laid(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Records as rows of WIDTH bytes, flat, with spare bytes behind."""
    cells = np.zeros(len(size) * WIDTH + WIDTH, np.uint8)
    column = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    cells[np.repeat(np.arange(len(size)) * WIDTH + begin, size) + column] = data
    return cells


def resolved(key: np.ndarray, run: np.ndarray, lead: np.ndarray, docs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each record the windows, as bits, that a record of a lesser document holds too."""
    size = run + LENGTH - 1
    ends = np.cumsum(size)
    spare = np.append(data, np.zeros(8, np.uint8))
    order, _ = ordered(key, contents(_words(spare, "<u8"), ends - size, run))
    marks = np.zeros(len(key), np.int64)
    new_key = np.append(True, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
    heads = np.append(np.flatnonzero(new_key), len(order))
    a = 0
    while a < len(heads) - 1:  # slices of whole keys
        b = max(a + 1, int(np.searchsorted(heads, heads[a] + SLICE, "right")) - 1)
        part = order[heads[a] : heads[b]]
        n, begin = size[part], WINDOW - lead[part]
        take = np.repeat((ends - size)[part] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        cells = _laid(data[take], begin, n)
        rows = cells[: len(part) * WIDTH].reshape(-1, WIDTH)
        new = np.ones(len(part), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1) | (n[1:] != n[:-1]) | (begin[1:] != begin[:-1])
        heads_ = np.flatnonzero(new)
        lowest = np.minimum.reduceat(docs[part], heads_)
        cells = np.append(rows[heads_].ravel(), np.zeros(WIDTH, np.uint8))
        row, place, first = first_documents(cells, begin[heads_], n[heads_], lowest)
        bits = np.bincount(row, np.where(first < lowest[row], 2.0**place, 0), len(heads_)).astype(np.int64)
        of = np.cumsum(new) - 1
        marks[part] = np.where(docs[part] > lowest[of], (1 << run[part]) - 1, bits[of])
        a = b
    return marks


def _sorted(table: pa.Table) -> pa.Table:
    """One bucket's records from all chunks -> marks (places, windows) for each chunk."""
    col = lambda n, kind: [np.frombuffer(x, kind) for x in table.column(n).to_pylist()]
    keys, counts, at, marks = col("keys", np.uint64), col("counts", np.uint32), col("at", np.uint32), col("marks", np.uint32)
    join = lambda n, kind: np.concatenate(col(n, kind))
    found = resolved(np.concatenate(keys), join("runs", np.uint8).astype(np.int64), join("leads", np.uint8).astype(np.int64), join("docs", np.int64), join("bytes", np.uint8))
    out, e = [], 0
    for k, n, places, done in zip(keys, counts, at, marks, strict=True):
        windows = np.repeat(found[e : e + len(k)], n)
        e += len(k)
        some = windows > 0
        out.append(np.stack([places[some], windows[some].astype(np.uint32)]).tobytes() if len(k) else done.tobytes())
    table = pa.table({"chunk": table.column("chunk"), "marks": pa.array(out, pa.binary())})
    return table.filter(pa.compute.greater(pa.compute.binary_length(table.column("marks")), 0))


def covered(size: int, marks: list[bytes]) -> np.ndarray:
    """The bytes that the marked windows cover."""
    pairs = [np.frombuffer(raw, np.uint32).reshape(2, -1) for raw in marks]
    at, windows = np.concatenate([np.zeros((2, 0), np.uint32), *pairs], axis=1).astype(np.int64)
    edge = np.zeros(size + LENGTH + 1, np.int8)
    for t in range(RUN):
        edge[at[(windows >> t & 1).astype(bool)] + t] = 1
    edge[LENGTH:] -= edge[:-LENGTH].copy()
    return np.cumsum(edge[:size], dtype=np.int32) > 0


def _cut(table: pa.Table, marks: pa.Table) -> pa.Table:
    """A chunk and its marks -> doc_id, n_bytes, removed spans and the bytes that are left."""
    table, data, offs, _, _, _ = _chunk(table)
    gone = covered(len(data), marks.column("marks").to_pylist())
    kept, starts, stops = [], [], []
    for a, b in zip(offs, offs[1:], strict=False):
        edge = np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))
        starts.append(np.flatnonzero(edge == 1))
        stops.append(np.flatnonzero(edge == -1))
        kept.append(data[a:b][~gone[a:b]].tobytes())
    ends = np.concatenate([[0], np.cumsum([len(x) for x in starts])]).astype(np.int32)
    join = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())
    spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([join(starts), join(stops)], ["start", "stop"]))
    return pa.table({"doc_id": table.column("doc_id"), "n_bytes": np.diff(offs), "spans": spans, "kept": pa.array(kept, pa.binary())})


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> chunk, pos, doc_id, text, in chunks of about CHUNK bytes."""
    chunk, pos, full = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        _, offs = buffer(batch.column(1))
        chunks, places = [], []
        for n in np.diff(offs).tolist():
            if full and full + n > CHUNK:
                chunk, pos, full = chunk + 1, 0, 0
            chunks.append(chunk)
            places.append(pos)
            pos, full = pos + 1, full + n
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(places, pa.int32()), *batch.columns], ["chunk", "pos", "doc_id", "text"])


def _bucketed(df: DataFrame) -> DataFrame:
    """df as a table bucketed by chunk in the shared folder: joins by chunk then leave it where it is."""
    spark = df.sparkSession
    name, path = f"ledgerloom_chunks_{uuid.uuid4().hex}", fresh(spark, "chunks")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").format("parquet").option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.stored_at, table.name = path, name
    return table


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start, stop), kept of every row of docs(doc_id, text): its UTF-8 bytes without those that 50-byte strings of smaller doc_ids cover.

    A null text is empty. Texts under 50 bytes are kept whole. Strings are judged on the
    input and may overlap. A null doc_id is smaller or larger than none: its text stays,
    and removes nothing. Rows of one doc_id remove nothing from each other, equal or not; each
    is judged by the smaller ones. ``kept`` is binary, as a character may lose some of its
    bytes. Other columns are ignored; an empty table gives an empty result. The tables that
    the result is read from are in ``tables``: release() deletes them once it is written.
    """
    ship(docs.sparkSession)
    plain = pick(docs, "doc_id", "text").toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = _bucketed(plain.mapInArrow(_chunks, "chunk long, pos int, doc_id long, text string"))
    total = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, (-(-total // BUCKET) - 1).bit_length())
    strings = chunks.groupBy("chunk").applyInArrow(_strings(bits), "bucket long, chunk long, strings binary")
    verdicts = stored(strings.groupBy("bucket").applyInArrow(_judged, "chunk long, bucket long, verdicts binary"), "verdicts")
    records = chunks.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(_records(bits), RECORDS)
    marks = stored(records.groupBy("bucket").applyInArrow(_sorted, "chunk long, marks binary"), "marks")
    out = chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
    out.tables = [chunks, verdicts, marks]
    return out


def release(repeats: DataFrame) -> None:
    """Delete the tables that remove_repeats() made: its result is written."""
    discard(*repeats.tables)
    repeats.sparkSession.sql(f"DROP TABLE {repeats.tables[0].name}")
