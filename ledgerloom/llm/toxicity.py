"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed terms i
of a document. The pairwise part, which lets an insult count more beside a mention of
a group than both do alone, costs as much as the linear part: it is half of
|sum v_i|^2 - sum |v_i|^2.

Terms are words and word beginnings (insults are inflected and compounded), each once
more for a second and a third use. The machine is trained on a bounded sample of
labelled rows. Terms that fewer than LEAST_DOCS rows of it hold have no weight; of the
others those have one that tell the classes apart

* alone: their share among toxic and other rows differs by over LEAST_Z standard errors; or
* in pairs: among the PAIRED most frequent terms, both of a pair whose common share
  differs by over LEAST_PAIR_Z standard errors, and by more than that of either alone
  (a group's name, say, that stands as often in clean rows as in toxic ones).

Counts are made on the executors; to the driver come the counts of these terms and a
bit for each row and term, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labelled import features, held_out, sample
from ._store import pick, ship, stored
from ._text import PUNCT, Words, mix, pieces, span_hashes, unmix

#: At most so many labelled rows train the machine.
TRAIN_ROWS = 5000
FACTORS = 4
LEAST_DOCS = 4
LEAST_Z, LEAST_PAIR_Z = 4.0, 6.0
#: Terms at most that tell classes apart alone; terms whose pairs are looked at.
MOST_TERMS, PAIRED = 16_384, 2048
#: Tasks that count the sample's terms, and bits by which these are counted at first.
TASKS, COARSE = 4, 23
#: Bytes of text that are counted at a time.
PART = 1 << 18
#: Lengths in bytes of the word beginnings that are terms too.
PREFIXES = (3, 4, 5, 6, 7, 8)
USES = 3
_BITS = 22


def terms(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(term of each use level, ascending within each text; first of each text, and the end).

    ``wanted`` (flags by leading hash bits) leaves out terms that have no weight anyway.
    """
    w = Words.of_column(pc.utf8_lower(texts), PUNCT)
    owner = w.owner()
    docs, hashes = [], []
    for k in (0, *PREFIXES):
        some = np.flatnonzero(w.ends - w.starts > k)
        starts = w.starts[some]
        x = mix(span_hashes(w.data, starts, starts + k if k else w.ends) + np.uint64(k))
        if wanted is not None:
            near = np.flatnonzero(wanted[x >> np.uint64(64 - _BITS)])
            some, x = some[near], x[near]
        docs.append(owner[some])
        hashes.append(x)
    doc, x = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    uses = np.diff(np.append(first, len(x)))
    at = np.concatenate([first[uses >= u] for u in range(1, USES + 1)])
    level = np.repeat(np.arange(1, USES + 1), [(uses >= u).sum() for u in range(1, USES + 1)])
    term, doc = mix(x[at] + level.astype(np.uint64)), doc[at]
    order = np.argsort(doc, kind="stable")
    return term[order], np.searchsorted(doc[order], np.arange(len(w.of)))


@dataclass
class Machine:
    bias: float
    hashes: np.ndarray  # of the terms that have weights, ascending
    weights: np.ndarray
    factors: np.ndarray
    wanted: np.ndarray

    def known(self, term: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with terms numbered, and those without weights left out."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros_like(of)
        at = np.minimum(np.searchsorted(self.hashes, term), len(self.hashes) - 1)
        kept = self.hashes[at] == term
        return at[kept], np.concatenate([[0], np.cumsum(kept)])[of]

    def parts(self, term: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each text before the sigmoid, sums of its factors)."""

        def total(x: np.ndarray) -> np.ndarray:
            sums = np.zeros((len(x) + 1, *x.shape[1:]))
            np.cumsum(x, axis=0, out=sums[1:])
            return np.diff(sums[of], axis=0)

        v = self.factors[term]
        s = total(v)
        return self.bias + total(self.weights[term]) + ((s * s).sum(1) - total((v * v).sum(1))) / 2, s

    def score(self, texts: pa.Array) -> np.ndarray:
        z, _ = self.parts(*self.known(*terms(texts, self.wanted)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def step(self, term: np.ndarray, of: np.ndarray, y: np.ndarray, seen: list[np.ndarray], rate: float, decay: float) -> None:
        """One step of AdaGrad down the mean log-loss."""
        z, s = self.parts(term, of)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        each = np.repeat(g, np.diff(of))
        row = np.repeat(np.arange(len(y)), np.diff(of))
        grad_w = np.bincount(term, each, len(self.weights)) + decay * self.weights
        diff = each[:, None] * (s[row] - self.factors[term])
        grad_v = np.stack([np.bincount(term, d, len(self.weights)) for d in diff.T], 1) + decay * self.factors
        for x, grad, at in ((self.weights, grad_w, seen[0]), (self.factors, grad_v, seen[1])):
            at += grad * grad
            x -= rate * grad / np.sqrt(at)
        seen[2] += g.sum() ** 2
        self.bias -= rate * g.sum() / np.sqrt(seen[2])


def standard_errors(n1: np.ndarray, n0: np.ndarray, rows1: int, rows0: int) -> np.ndarray:
    """By how many standard errors the shares n1 of rows1 toxic rows and n0 of rows0 others differ."""
    rows1, rows0 = max(rows1, 1), max(rows0, 1)
    share = (n1 + n0) / (rows1 + rows0)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / rows1 + 1 / rows0))
    return (n1 / rows1 - n0 / rows0) / error


def often(some: DataFrame) -> np.ndarray:
    """Flags by leading bits of the terms that LEAST_DOCS rows of the sample may hold.

    Most terms stand in one row. Each of TASKS tasks counts all of its terms by their
    leading bits, a byte a count, so TASKS times 2**COARSE bytes come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << COARSE, np.uint8)
        for batch in batches:
            for _, texts in pieces(batch.column(0), PART):
                bins, n = np.unique(terms(texts)[0] >> np.uint64(64 - COARSE), return_counts=True)
                out[bins] = np.minimum(out[bins] + n, 255)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["counts"])

    total = np.zeros(1 << COARSE, np.uint16)
    for row in some.select("text").coalesce(TASKS).mapInArrow(run, "counts binary").collect():
        total += np.frombuffer(row.counts, np.uint8)
    return total >= LEAST_DOCS


def counted(some: DataFrame) -> DataFrame:
    """term, n (rows of the sample that hold it) and n1 (toxic ones) of the terms that LEAST_DOCS rows hold."""
    ship(some.sparkSession)
    sent = some.sparkSession.sparkContext.broadcast(np.packbits(often(some)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(sent.value).view(bool)
        for batch in batches:
            for a, texts in pieces(batch.column(1), PART):
                label = batch.column(0).slice(a, len(texts)).to_numpy()
                term, of = terms(texts)
                owner = np.repeat(label, np.diff(of))
                some = wanted[term >> np.uint64(64 - COARSE)]
                each, at, n = np.unique(term[some], return_inverse=True, return_counts=True)
                n1 = np.bincount(at, owner[some], len(each)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(n1)], ["term", "n", "n1"])

    out = some.select("label", "text").coalesce(TASKS).mapInArrow(run, "term long, n long, n1 long")
    return out.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).filter(F.col("n") >= LEAST_DOCS)


def _column(rows: list) -> np.ndarray:
    return np.sort(np.array([r.term for r in rows], np.int64).view(np.uint64))


def paired(held: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The columns of rows x terms that tell classes apart in pairs (see above)."""
    toxic = y > 0
    alone = np.abs(standard_errors(held[toxic].sum(0), held[~toxic].sum(0), toxic.sum(), (~toxic).sum()))
    chosen = np.zeros(held.shape[1], bool)
    x1, x0 = held[toxic].astype(np.float32), held[~toxic].astype(np.float32)
    for a in range(0, held.shape[1], 256):
        z = np.abs(standard_errors(x1[:, a : a + 256].T @ x1, x0[:, a : a + 256].T @ x0, len(x1), len(x0)))
        pair = (z > LEAST_PAIR_Z) & (z > alone + LEAST_Z) & (z > alone[a : a + 256, None] + LEAST_Z)
        chosen[a : a + 256] |= pair.any(1)
        chosen |= pair.any(0)
    return np.flatnonzero(chosen)


def bits(some: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x terms, whether the row holds the term; label of each row)."""
    sent = some.sparkSession.sparkContext.broadcast((hashes, flags(hashes)))

    def make(texts: pa.Array, _: list) -> list[bytes]:
        hashes, wanted = sent.value
        term, of = terms(texts, wanted)
        held = np.zeros((len(texts), len(hashes)), bool)
        at = np.minimum(np.searchsorted(hashes, term), len(hashes) - 1)
        known = hashes[at] == term
        held[np.repeat(np.arange(len(texts)), np.diff(of))[known], at[known]] = True
        return [x.tobytes() for x in np.packbits(held, axis=1)]

    rows = features(some, make)
    packed = np.stack([np.frombuffer(x, np.uint8) for x, _ in rows])
    return np.unpackbits(packed, axis=1, count=len(hashes)).view(bool), np.array([y for _, y in rows], float)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Machine:
    """A machine from at most ``most`` labelled rows outside the held-out fold."""
    return fit_sample(sample(docs, labels, "toxic", most))


def fit_sample(some: DataFrame) -> Machine:
    counts = stored(counted(some), "terms")
    n1, n = some.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return train(np.zeros((0, 0), bool), np.zeros(0), np.zeros(0, np.uint64))
    frequent = _column(counts.orderBy(F.col("n").desc(), "term").limit(PAIRED).collect())
    share = F.col("n") / n
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / max(n1, 1) + 1 / max(n - n1, 1)))
    z = F.abs(F.col("n1") / max(n1, 1) - (F.col("n") - F.col("n1")) / max(n - n1, 1)) / error
    hashes = _column(counts.filter(z > LEAST_Z).orderBy(z.desc(), "term").limit(MOST_TERMS).collect())
    if len(frequent):
        held, y = bits(some, frequent)
        hashes = np.union1d(hashes, frequent[paired(held, y)])
        del held
    if not len(hashes):
        return train(np.zeros((n, 0), bool), np.repeat([1.0, 0.0], [n1, n - n1]), hashes)
    return train(*bits(some, hashes), hashes)


def train(held: np.ndarray, y: np.ndarray, hashes: np.ndarray, rounds: int = 200, rate: float = 0.2, decay: float = 3e-4) -> Machine:
    """From rows x terms and labels. Without rows every text scores 0."""
    rng = np.random.default_rng(5)
    prior = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else -30.0
    out = Machine(prior, hashes, np.zeros(len(hashes)), rng.normal(0, 0.01, (len(hashes), FACTORS)), flags(hashes))
    if not len(hashes):
        return out
    of = np.concatenate([[0], np.cumsum(held.sum(1))])
    term = np.nonzero(held)[1]
    # sums of squares start well above the gradients of terms that tell nothing, which so move little
    seen = [np.full(len(hashes), 1e-4), np.full((len(hashes), FACTORS), 1e-4), np.array(1e-4)]
    for _ in range(rounds):
        out.step(term, of, y, seen, rate, decay)
    return out


def flags(hashes: np.ndarray) -> np.ndarray:
    """Leading bits of the plain terms that any use level of may be among the hashes."""
    out = np.zeros(1 << _BITS, bool)
    for u in range(1, USES + 1):
        out[(unmix(hashes) - np.uint64(u)) >> np.uint64(64 - _BITS)] = True
    return out


def score(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text), as labels(doc_id, toxic) teach.

    Null texts count as empty: they get the prior's score. Repeated rows are scored
    each; a null doc_id isn't held out. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    machine = spark.sparkContext.broadcast(fit(docs, labels, most))
    docs = pick(docs, "doc_id", "text")
    schema = T.StructType([docs.schema[0], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in pieces(batch.column(1)):
                scores = machine.value.score(texts.fill_null("")).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(scores)], ["doc_id", "score"])

    scored = docs.mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
