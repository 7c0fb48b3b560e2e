"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts makes, per document, the set of distinct word shingles,
   its digest, a MinHash signature and the band keys of that signature.
2. Equal sets are folded on their digest of 128 bits; only representatives go on.
3. Band buckets propose candidates. A bucket is never expanded into its pairs: its
   smallest document is the pivot, and (pivot, member) pairs are compared by their
   signatures, batch of rows after batch. A pair is dropped as soon as the posterior
   probability of reaching the threshold is below ``miss``. Survivors are verified on
   the full shingle sets, in chunks of at most about CHUNK members of one pivot: texts
   are read for survivors only, and the pivot's once a chunk.
4. The buckets of one pivot form a group. One whose members all link to the pivot is
   done, as it is connected. The members of any other are dealt into blocks of about
   BLOCK, and each pair of blocks goes to a task of its own, which compares signatures
   in the same way and skips what is connected already; then texts are read for those
   members that a candidate of that pair of blocks is left of. No pair leaves a task but
   verified links, at most one a member; no pair of a bucket is left uncompared.
5. Connected components of the links, by alternating min-label rounds on tables.

Tables that a hot key or pivot is joined with are written first, so that both sides of
the join are plain shuffles, whose large partitions Spark splits (adaptive skew join).
Texts are dealt by a sort-merge join at every size, as what they are joined with grows
with them.

Bands of 4 rows, 32 of them: a pair at similarity 0.8 is missed with probability
(1 - 0.8**4)**32 < 5e-8; the posterior bound adds ``miss`` = 1e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, numbered, pick, ship, stored
from ._text import Words, constants, mix, pieces, windows

ROWS, BANDS = 4, 32
SIGNATURE = ROWS * BANDS
BATCH = 32
MISS = 1e-6
BLOCK, CHUNK = 512, 256


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; a shorter text is one shingle."""
    words = Words.of_column(texts)
    hashes = words.hashes()
    win, at = windows(hashes, words.of, k)
    of = np.searchsorted(at, words.of)
    out = []
    for i in range(len(texts)):
        a, b = words.of[i], words.of[i + 1]
        if b - a >= k:
            out.append(np.unique(win[of[i] : of[i + 1]]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * constants(k, 12)[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each of SIGNATURE multiply-shift hashes over the set."""
    a = constants(SIGNATURE, 7)
    least = np.full(SIGNATURE, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[i : i + 2048, None] * a).min(0))
    return least


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(mix(shingles ^ c).sum(dtype=np.uint64).view(np.int64)) for c in constants(2, 21))


def _profile(k: int):
    """docs(doc_id, text, th) -> doc_id, th, n, d0, d1, sig (a byte a row), bands (of non-empty sets).

    A row's byte is taken of its mixed minimum: minima of large sets are all small, and
    their own leading bytes would agree by chance.
    """
    schema = "doc_id long, th long, n long, d0 long, d1 long, sig binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = constants(ROWS, 31)
        for batch in batches:
            for a, texts in pieces(batch.column(1)):
                sets = shingle_sets(texts, k)
                digests = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
                full = np.array([signature(s) for s in sets], np.uint64).reshape(-1, SIGNATURE)
                keys = mix((full.reshape(-1, BANDS, ROWS) * c).sum(2, dtype=np.uint64) + constants(BANDS, 32)).view(np.int64)
                some = np.array([len(s) > 0 for s in sets])
                offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(texts)),
                        batch.column(2).slice(a, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        pa.array([x.tobytes() for x in (mix(full) >> np.uint64(56)).astype(np.uint8)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1))),
                    ],
                    ["doc_id", "th", "n", "d0", "d1", "sig", "bands"],
                )

    return run, schema


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each number of compared rows, the matches below which P(similarity >= threshold) < miss.

    With a uniform prior the posterior is a Beta law, whose tail is a binomial sum:
    P(s >= t | m of n match) = P(Binomial(n + 1, t) <= m). Rows are stored as a byte
    each; chance matches only raise m, so the bound stays safe.
    """
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SIGNATURE)


def _prune(threshold: float, miss: float):
    """Candidates with both signatures -> those that the posterior bound keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold, miss)
        for batch in batches:
            a, b = _bytes(batch.column("sig_a")), _bytes(batch.column("sig_b"))
            alive = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, np.int64)
            for i, m in enumerate(least):
                part = slice(i * BATCH, (i + 1) * BATCH)
                matches[alive] += (a[alive, part] == b[alive, part]).sum(1)
                alive = alive[matches[alive] >= m]
            yield batch.select(["pivot", "doc"]).take(pa.array(alive))

    return run


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = common(x, y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _verify(k: int, percent: int):
    """A chunk of one pivot's members, and the pivot, with their texts -> the pairs whose full sets reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        docs, pivots = table.column("doc").to_numpy(), table.column("pivot").to_numpy()
        texts = table.column("text").combine_chunks()
        first = int(np.flatnonzero(docs == pivots)[0])
        pivot = shingle_sets(texts.slice(first, 1), k)[0]
        kept = []
        for a, part in pieces(texts):
            kept += [i for i, x in enumerate(shingle_sets(part, k), a) if docs[i] != pivots[i] and linked(pivot, x, percent)]
        return pa.table({"pivot": pa.array(pivots[kept], pa.int64()), "doc": pa.array(docs[kept], pa.int64())})

    return run


def overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Intersection size of each pair (i, j) of sorted sets."""
    if len(pairs) < 256:
        return np.array([common(sets[i], sets[j]) for i, j in pairs], np.int64)
    rows, pairs = np.unique(pairs, return_inverse=True)
    pairs = pairs.reshape(-1, 2)
    _, of, n = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    shared = n > 1  # what only one set has is in no intersection
    column = (np.cumsum(shared) - 1)[of]
    row, column = row[shared[of]], column[shared[of]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(rows), len(rows)), np.float32)
    for c in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, [c, c + 2048])
        x = np.zeros((len(rows), 2048), np.float32)
        x[row[a:b], column[a:b] - c] = 1
        both += x @ x.T
    return both[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _candidates(table: pa.Table, percent: int, miss: float) -> np.ndarray:
    """Pairs (i, j) of a pair of blocks' rows that aren't connected yet and that the posterior bound keeps."""
    least = least_matches(percent / 100, miss)
    cls, n, block = (table.column(c).to_numpy() for c in ("cls", "n", "block"))
    sig = _bytes(table.column("sig"))
    two = len(np.unique(block)) > 1
    kept = [np.zeros((0, 2), np.int64)]
    for i in range(len(cls) - 1):
        j = np.arange(i + 1, len(cls))
        near = (cls[j] != cls[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))
        j = j[near & (block[j] != block[i])] if two else j[near]
        matches = np.zeros(len(j), np.int64)
        for q, m in enumerate(least):
            part = slice(q * BATCH, (q + 1) * BATCH)
            matches = matches + np.count_nonzero(sig[j, part] == sig[i, part], axis=1)
            j, matches = j[matches >= m], matches[matches >= m]
            if not len(j):
                break
        kept.append(np.stack([np.full(len(j), i), j], 1))
    return np.concatenate(kept)


def _wanted(percent: int, miss: float):
    """One pair of blocks of an unfinished group, without texts -> its members that have a candidate in it."""

    def run(table: pa.Table) -> pa.Table:
        return table.take(pa.array(np.unique(_candidates(table, percent, miss)))).select(["pivot", "x", "y", "block", "doc", "cls", "n", "sig"])

    return run


def _blocks(k: int, percent: int, miss: float):
    """Such members with their texts -> links that connect what is linked among them.

    Members of one class are connected already; classes are merged as links are found,
    so that at most one link a member goes out.
    """

    def run(table: pa.Table) -> pa.Table:
        docs, cls, n = (table.column(c).to_numpy() for c in ("doc", "cls", "n"))
        pairs = _candidates(table, percent, miss)
        out = []
        if len(pairs):
            used, where = np.unique(pairs, return_inverse=True)
            texts = table.column("text").combine_chunks().take(pa.array(used))
            both = overlaps([x for _, part in pieces(texts) for x in shingle_sets(part, k)], where.reshape(-1, 2))
            union = n[pairs[:, 0]] + n[pairs[:, 1]] - both
            class_ = dict(zip(cls.tolist(), cls.tolist(), strict=True))

            def top(x: int) -> int:
                while class_[x] != x:
                    class_[x] = x = class_[class_[x]]
                return x

            for i, j in pairs[(both > 0) & (100 * both >= percent * union)]:
                a, b = top(int(cls[i])), top(int(cls[j]))
                if a != b:
                    class_[a] = b
                    out.append((docs[i], docs[j]))
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"pivot": a, "doc": b})

    return run


def _links(reps: DataFrame, docs: DataFrame, repeated: bool, k: int, percent: int, miss: float) -> DataFrame:
    """Enough verified links (pivot, doc) between representatives to connect all that are linked.

    reps: doc, n, sig, bands, and doc_id and th of the row that holds the text. docs:
    doc_id, th, text; ``repeated`` tells that some (doc_id, th) stand there twice.
    """
    keyed = reps.select("doc", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("doc").alias("pivot"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    buckets = stored(buckets, "buckets")
    members = stored(keyed.join(buckets, "key").filter("doc <> pivot").select("pivot", "doc").distinct(), "members")
    discard(buckets)
    active = members.select("doc").union(members.select("pivot")).distinct()
    signed = stored(reps.join(active, "doc", "left_semi").select("doc", "n", "sig", "doc_id", "th"), "signed")

    pairs = members
    for on, a in (("pivot", "a"), ("doc", "b")):
        pairs = pairs.join(signed.select(F.col("doc").alias(on), F.col("n").alias(f"n_{a}"), F.col("sig").alias(f"sig_{a}")), on)
    pairs = pairs.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    alive = stored(pairs.select("pivot", "doc", "sig_a", "sig_b").mapInArrow(_prune(percent / 100, miss), "pivot long, doc long"), "alive")

    # a group that the signatures tell apart from its pivot has no text read yet, but some of its members may link
    texts = docs.hint("merge").join(signed.select("doc", "doc_id", "th"), ["doc_id", "th"]).select("doc", "text")
    texts = stored(texts.dropDuplicates(["doc"]) if repeated else texts, "texts")
    chunks = alive.groupBy("pivot").agg(F.expr(f"cast((count(1) + {CHUNK - 1}) div {CHUNK} as int)").alias("chunks"))
    chunks = stored(chunks, "chunks")
    dealt = alive.join(chunks, "pivot").select("pivot", F.expr("cast(pmod(xxhash64(doc, pivot), chunks) as int)").alias("chunk"), "doc")
    dealt = dealt.unionByName(chunks.select("pivot", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.col("pivot").alias("doc")))
    links = stored(dealt.join(texts, "doc").groupBy("pivot", "chunk").applyInArrow(_verify(k, percent), "pivot long, doc long"), "links")
    discard(alive, chunks)

    seen = members.join(links.withColumn("hit", F.lit(True)), ["pivot", "doc"], "left")
    seen = stored(seen.select("pivot", "doc", F.expr("if(hit, pivot, doc)").alias("cls")), "seen")
    # a group is done once its members are connected: all with the pivot, or one alone
    sizes = seen.groupBy("pivot").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.count(F.lit(1)).alias("m")).filter("a <> b")
    sizes = stored(sizes.select("pivot", F.expr(f"cast((m + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks")), "sizes")
    rest = seen.join(sizes, "pivot")
    rest = rest.withColumn("block", F.expr("cast(pmod(xxhash64(doc, pivot), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rest = rest.select("pivot", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "doc", "cls")
    rest = rest.join(signed.select("doc", "n", "sig"), "doc")
    wanted = rest.groupBy("pivot", "x", "y").applyInArrow(_wanted(percent, miss), "pivot long, x int, y int, block int, doc long, cls long, n long, sig binary")
    wanted = stored(wanted, "wanted")
    more = wanted.join(texts, "doc").groupBy("pivot", "x", "y").applyInArrow(_blocks(k, percent, miss), "pivot long, doc long")
    more = stored(more, "links")
    discard(members, seen, sizes, signed, wanted, texts)
    return links.unionByName(more)


def named_apart(reps: DataFrame) -> DataFrame:
    """reps(doc, d0, d1, n, ...), of whose names ``doc`` some may agree, with a name of its own for each.

    Names are 64 bits of the digests: among 10**10 documents a few agree.
    """
    turn = 0
    while True:
        twice = reps.groupBy("doc").agg(F.min(F.struct("d0", "d1", "n")).alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
        if twice.isEmpty():
            return reps
        stays = F.col("least").isNull() | (F.col("least") == F.struct("d0", "d1", "n"))
        renamed = reps.join(stored(twice, "twice"), "doc", "left").withColumn("doc", F.when(stays, F.col("doc")).otherwise(F.xxhash64("d0", "d1", "n", F.lit(turn))))
        reps, turn = stored(renamed.select(*reps.columns), "reps"), turn + 1


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, component: the least node reachable, for every node with a link.

    Min-label rounds with pointer jumping: each node takes the least label among
    its own, its neighbours' and its label's; the depth halves each time.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("b", "node").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        before = labels
        step = stored(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new")), "steps")
        hop = step.select(F.col("node").alias("new"), F.col("new").alias("hop"))
        labels = stored(step.join(hop, "new").select("node", F.least("new", "hop").alias("label"), (F.least("new", "hop") != F.col("label")).alias("moved")), "labels")
        discard(before, step)
        if labels.filter("moved").isEmpty():
            discard(edges)
            return labels.select("node", F.col("label").alias("component"))


def _grouped(docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles and component_id of every row of docs(doc_id, text, th)."""
    run, schema = _profile(k)
    prof = stored(docs.mapInArrow(run, schema), "profiles")
    real = prof.filter("n > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "th")).alias("least")
    # a representative is named by its digest, as doc_ids may repeat
    reps = real.groupBy("d0", "d1", "n").agg(least, F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = stored(reps.select(F.col("d0").alias("doc"), "d0", "d1", "n", F.col("least.doc_id").alias("doc_id"), F.col("least.th").alias("th"), "sig", "bands"), "reps")
    reps = named_apart(reps)
    repeated = not real.groupBy("doc_id", "th").count().filter("count > 1").isEmpty()
    links = _links(reps, docs, repeated, k, percent, miss)
    comps = components(links.select(F.col("pivot").alias("a"), F.col("doc").alias("b")))
    names = reps.select("doc", "d0", "d1", "n", F.col("doc_id").alias("first_id")).join(comps, F.col("doc") == F.col("node"), "left")
    named = stored(names.select("d0", "d1", "n", "first_id", F.coalesce("component", "doc").alias("component")), "named")
    least = stored(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    components_ = named
    named = stored(named.join(least, "component").select("d0", "d1", "n", "component_id"), "named")
    discard(components_, least, reps)
    shaped = ["doc_id", "th", F.col("n").alias("n_shingles"), "component_id"]
    out = real.join(named, ["d0", "d1", "n"]).select(*shaped)
    return out.unionByName(prof.filter("not (n > 0 and doc_id is not null)").withColumn("component_id", F.col("doc_id")).select(*shaped))


def _shaped(docs: DataFrame) -> DataFrame:
    docs = pick(docs, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are separated by ASCII white space, A-Z lower-cased. Null and word-less
    texts have no shingles and link with nothing: each is its own component. Texts
    of fewer than k words are one shingle. Repeated rows stay repeated and share a
    component, as do rows with one doc_id only if their texts link; a null doc_id
    gets a null component and is kept. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    out = _grouped(_shaped(docs), k, percent, miss).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row of docs for each group of near-duplicates: that of the least doc_id, with all its columns as they were.

    Of several rows with that doc_id the one of the least text hash stays, and of rows
    that agree in both any one. Rows with a null doc_id stay, as do those without words,
    of which repeated ones count once. Columns may have any names.
    """
    ship(docs.sparkSession)
    names, plain = docs.columns, numbered(docs)
    ids, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    groups = stored(_grouped(_shaped(docs), k, percent, miss).filter("doc_id is not null"), "groups")
    own = groups.filter("doc_id = component_id")
    first = F.expr("if(n_shingles > 0, null, th)")  # word-less texts of one doc_id are groups of their own
    kept = own.groupBy("doc_id", first.alias("empty")).agg(F.min("th").alias("th"), F.count(F.lit(1)).alias("m"))
    # what goes are far fewer rows than what stays
    stays = kept.select("doc_id", "th", F.lit(True).alias("stays"))
    gone = stored(groups.select("doc_id", "th").distinct().join(stays, ["doc_id", "th"], "left_anti"), "gone")
    th = F.xxhash64(F.col(text).cast("string"))
    left = plain.hint("merge").join(gone.toDF("g0", "g1"), (F.col(ids).cast("long") == F.col("g0")) & (th == F.col("g1")), "left_anti")
    if not own.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        again = own.groupBy("doc_id", "th").count().filter("count > 1").select("doc_id", "th").toDF("g0", "g1")
        match = (F.col(ids).cast("long") == F.col("g0")) & (th == F.col("g1"))
        one = left.join(again, match, "left_semi").dropDuplicates([ids, text])
        left = left.join(again, match, "left_anti").unionByName(one)
    return left.toDF(*names)
