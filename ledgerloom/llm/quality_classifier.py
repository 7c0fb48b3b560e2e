"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A document's terms are its words (A-Z lower-cased), hashed into WORD_BINS; the shapes of
its words (classes of letters, digits and marks, runs of a class folded), hashed into
SHAPE_BINS; and a few counts of structure: symbols, repeated lines, repeated word windows,
words. Log frequencies, weighted by inverse document frequency, are projected on the
leading right singular vectors of a bounded labelled sample, found by random projection
and power steps. Only hashed frequencies of the sample come to the driver, never its
texts. The sample's vectors and labels go to every task; each document's exact cosines to
all of them are computed in blocks, and its NEIGHBOURS nearest vote with their
similarity; of equally near ones the first of the sample vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labelled import features, held_out, sample
from ._store import pick, ship
from ._text import Words, pieces, span_hashes
from .quality_rules import lines

#: At most so many labelled rows are neighbours.
TRAIN_ROWS = 4000
WORD_BINS, SHAPE_BINS = 2048, 1024
LATENT = 48
NEIGHBOURS = 25
BLOCK = 512
STRUCTURE = 6
WIDTH = WORD_BINS + SHAPE_BINS + STRUCTURE

#: Classes of bytes in a shape: a letter, A capital, 9 digit; any other ASCII byte is itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x61:0x7B] = SHAPE[0x80:] = ord("a")
SHAPE[0x41:0x5B] = ord("A")
SHAPE[0x30:0x3A] = ord("9")


def frequencies(texts: pa.Array) -> np.ndarray:
    """Log term frequencies of each text, as texts x WIDTH."""
    w = Words.of_column(texts)
    shape = SHAPE[w.data]
    start = np.zeros(len(shape), bool)
    start[w.starts] = True
    fold = np.zeros(len(shape), bool)
    fold[1:] = (shape[1:] == shape[:-1]) & ~start[1:]
    place = np.zeros(len(shape) + 1, np.int64)
    np.cumsum(~fold, out=place[1:])
    shapes = span_hashes(shape[~fold], place[w.starts], place[w.ends], fold=False)
    n, owner = len(w.of) - 1, w.owner()
    binned = lambda x, bins: np.bincount(owner * bins + (x % np.uint64(bins)).astype(np.int64), minlength=n * bins).reshape(n, bins)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :WORD_BINS] = binned(w.hashes(), WORD_BINS)
    out[:, WORD_BINS:-STRUCTURE] = binned(shapes, SHAPE_BINS)
    got = lines(texts)
    words, chars, symbols, dup, repeat = got.counts.T
    n_lines = np.diff(got.of)
    out[:, -STRUCTURE:] = np.stack([words, symbols, 20 * dup, repeat, n_lines, 10 * chars / np.maximum(words, 1)], 1)
    return np.log1p(out)


@dataclass
class Neighbours:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, freq: np.ndarray) -> np.ndarray:
        x = (freq * self.idf) @ self.basis
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Share of the label 1 among the nearest, weighted by similarity; without any sample 0.5."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), BLOCK):
            cos = self.project(frequencies(texts.slice(a, BLOCK))) @ self.vectors.T
            least = np.partition(cos, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
            nearer, as_near = cos > least, cos == least
            near = nearer | (as_near & (np.cumsum(as_near, axis=1) <= k - nearer.sum(1, keepdims=True)))
            row, at = np.nonzero(near)
            weight = np.maximum(cos[row, at], 1e-6).astype(float) ** 8
            out[a : a + BLOCK] = np.bincount(row, weight * self.labels[at], len(cos)) / np.bincount(row, weight, len(cos))
        return out


def leading(x: np.ndarray, n: int) -> np.ndarray:
    """The n leading right singular vectors of x, as columns."""
    q = np.random.default_rng(3).normal(size=(x.shape[1], n + 16)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    vectors = np.linalg.svd(x @ q, full_matrices=False)[2]
    basis = (q @ vectors.T)[:, :n]
    return basis.astype(np.float32)


def train(freq: np.ndarray, labels: np.ndarray) -> Neighbours:
    if not len(freq):
        return Neighbours(np.ones(WIDTH, np.float32), np.zeros((WIDTH, LATENT), np.float32), np.zeros((0, LATENT), np.float32), np.zeros(0))
    idf = np.log((1 + len(freq)) / (1 + (freq > 0).sum(0))).astype(np.float32) + 0.5
    got = Neighbours(idf, leading(freq * idf, LATENT), np.zeros((0, LATENT), np.float32), labels.astype(float))
    got.vectors = got.project(freq).astype(np.float32)
    return got


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Neighbours:
    """Neighbours from at most ``most`` labelled rows outside the held-out fold."""
    rows = features(sample(docs, labels, "quality", most), lambda texts, _: [x.tobytes() for x in frequencies(texts).astype(np.float16)])
    freq = np.stack([np.frombuffer(x, np.float16) for x, _ in rows]).astype(np.float32) if rows else np.zeros((0, WIDTH), np.float32)
    return train(freq, np.array([y for _, y in rows]))


def score(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text), as labels(doc_id, quality) teach.

    Null texts count as empty and are scored like any other. Repeated rows are scored
    each; a null doc_id isn't held out. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, most))
    docs = pick(docs, "doc_id", "text")
    schema = T.StructType([docs.schema[0], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(model.value.score(texts.fill_null("")))], ["doc_id", "score"])

    scored = docs.mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
