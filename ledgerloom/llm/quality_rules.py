"""Quality rules: counts of a document, and a line-labelling CRF that decides retention.

A linear-chain conditional random field marks each line that holds a word as content
or boilerplate; Viterbi decoding finds the likeliest labelling of a document, and the
share of its words that stand in content lines decides whether it stays.

Lines have labels of their own in training. A line counts as repeated if it is at least
1 / REPEATED of all lines of the corpus, counted over all documents; there are at most
REPEATED such lines, which are sent to every task. In a good document of the labelled
sample, repeated lines among words that aren't are boilerplate, all else is content
(where most of the words are in repeated lines, the document has copies). In a bad document all lines
are boilerplate at first. Then the labels are latent: the field is fitted to them, and
its own decoding gives the next labels, held to what the document's label says: most
words of a good document are content, most of a bad one aren't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labelled import features, sample
from ._store import numbered, pick, ship, stored
from ._text import SPACE, Words, mix, pieces, span_hashes, windows

#: At most so many labelled documents train the field, with so many successive lines of each.
TRAIN_DOCS, TRAIN_LINES = 4000, 256
#: A line is repeated if it is at least this part of all lines, and stands in so many documents.
REPEATED, LEAST_DOCS = 20_000, 3
#: Times that the field's own decoding gives the labels it is fitted to, and steps of each fit.
TURNS, STEPS = 4, 120
#: Least share of words in content lines of a document that stays.
CONTENT_SHARE = 0.5
FEATURES = ("bias", "symbols", "upper", "shouts", "repeated line", "in repeated windows", "word twice", "short", "digits", "length", "clean length", "repeated alone")
ALONE = FEATURES.index("repeated alone")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _is(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


SYMBOL, SHOUT, DIGIT, UPPER, LOWER = _is("#*$%&|<>"), _is("!"), _is("0123456789"), _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is("abcdefghijklmnopqrstuvwxyz")


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive positions."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


@dataclass
class Lines:
    """Counts per document, and features of the lines that hold a word."""

    counts: np.ndarray  # documents x COUNTS
    features: np.ndarray  # lines x FEATURES
    words: np.ndarray  # per line
    of: np.ndarray  # first line of each document, and the end


def line_spans(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end of each line that holds a word, which of them each word is in)."""
    data = w.data
    starts = np.unique(np.concatenate([w.offs[:-1], np.flatnonzero(data == 0x0A) + 1]))  # from each text's start and after each \n
    starts = starts[starts < len(data)]
    full, of_word = np.unique(np.searchsorted(starts, w.starts, "right") - 1, return_inverse=True)
    ends = np.append(starts[1:], len(data))[full]
    starts = starts[full]
    ends = np.where((ends > starts) & (data[ends - 1] == 0x0A), ends - 1, ends) if len(full) else ends
    return starts, ends, of_word


def lines(texts: pa.Array, repeated: np.ndarray | None = None) -> Lines:
    """repeated: hashes of the lines that are repeated in the corpus, ascending."""
    w = Words.of_column(texts)
    data, offs, n_docs = w.data, w.offs, len(w.offs) - 1
    hashes = w.hashes(fold=False)
    doc = w.owner()
    counts = np.zeros((n_docs, len(COUNTS)), np.int64)
    counts[:, 0] = w.counts()
    counts[:, 1] = _sums(~SPACE[data] & ((data & 0xC0) != 0x80), offs)
    counts[:, 2] = _sums(SYMBOL[data], offs)
    # words in 3-word windows that a text holds twice
    win, at = windows(hashes, w.of, 3)
    code, _ = pd.factorize(mix(win + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    twice = at[np.bincount(code, minlength=1)[code] > 1] if len(at) else at
    cover = np.zeros(len(hashes) + 4, np.int64)
    for k in range(3):
        cover[twice + k] = 1
    cover = cover[: len(hashes)] > 0
    counts[:, 4] = np.bincount(doc[cover], minlength=n_docs)[:n_docs]
    starts, ends, of_word = line_spans(w)
    full = starts
    n_words = np.bincount(of_word, minlength=len(full))
    owner = np.searchsorted(offs, starts, "right") - 1
    # owners of empty texts share an offset: the last one that begins here holds the line
    same_line = span_hashes(data, starts, ends, fold=False)
    key = mix(same_line + owner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    dup = pd.Series(key).duplicated().to_numpy()
    counts[:, 3] = np.bincount(owner[dup], minlength=n_docs)[:n_docs]
    known = np.zeros(len(full))
    if repeated is not None and len(repeated):
        known = (repeated[np.minimum(np.searchsorted(repeated, same_line), len(repeated) - 1)] == same_line).astype(float)
    known_words = known * n_words
    others = (np.bincount(owner, known_words, minlength=n_docs)[owner] - known_words) / np.maximum(counts[owner, 0] - n_words, 1)
    edges = np.stack([starts, ends], 1).reshape(-1)
    per = lambda flags: _sums(flags, edges)[::2] if len(edges) else np.zeros(0, np.int64)
    upper, lower, chars = per(UPPER[data]), per(LOWER[data]), np.maximum(ends - starts, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    length = np.minimum(np.log1p(n_words) / 5, 1.5)
    x = np.stack(
        [
            np.ones(len(full)),
            np.minimum(per(SYMBOL[data]) / np.maximum(n_words, 1), 1),
            upper / np.maximum(upper + lower, 1),
            np.minimum(per(SHOUT[data]) / np.maximum(n_words, 1), 1),
            dup,
            np.bincount(of_word[cover], minlength=len(full)) / np.maximum(n_words, 1),
            np.bincount(of_word[same], minlength=len(full)) / np.maximum(n_words, 1),
            n_words < 4,
            per(DIGIT[data]) / chars,
            length,
            length * (per((SYMBOL | SHOUT)[data]) * 10 < n_words),
            known * (1 - others),
        ],
        1,
    ).astype(float)
    return Lines(counts, x, n_words, np.searchsorted(owner, np.arange(n_docs + 1)))


@dataclass
class Field:
    """Weights of the chain: unary (state 1, content, against state 0), and transitions[from, to]."""

    unary: np.ndarray
    moves: np.ndarray
    repeated: np.ndarray | None = None

    def _steps(self, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(t, documents that have a line t), documents by falling length."""
        n = np.diff(of)
        order = np.argsort(-n, kind="stable")
        falling = -n[order]
        for t in range(int(n.max()) if len(n) else 0):
            yield t, order[: np.searchsorted(falling, -t, "left")]

    def viterbi(self, lines_: Lines) -> np.ndarray:
        """The likeliest label of every line."""
        score = np.stack([np.zeros(len(lines_.features)), lines_.features @ self.unary], 1)
        back = np.zeros((len(score), 2), np.int8)
        best = np.zeros((len(lines_.of) - 1, 2))
        steps = list(self._steps(lines_.of))
        for t, docs in steps:
            at = lines_.of[docs] + t
            if t:
                paths = best[docs][:, :, None] + self.moves
                back[at] = paths.argmax(1)
                best[docs] = paths.max(1)
            best[docs] += score[at]
        out = np.zeros(len(score), np.int8)
        state = best.argmax(1).astype(np.int8)
        for t, docs in reversed(steps):
            at = lines_.of[docs] + t
            out[at] = state[docs]
            state[docs] = back[at, state[docs]]
        return out

    def gradient(self, lines_: Lines, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the log-likelihood of the lines' labels, by forward and backward passes."""
        score = np.stack([np.zeros(len(lines_.features)), lines_.features @ self.unary], 1)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        steps = list(self._steps(lines_.of))
        for t, docs in steps:
            at = lines_.of[docs] + t
            ahead[at] = score[at] + (np.logaddexp.reduce(ahead[at - 1][:, :, None] + self.moves, axis=1) if t else 0)
        for t, docs in reversed(steps):
            prev = lines_.of[docs] + t - 1
            if t:
                behind[prev] = np.logaddexp.reduce(self.moves + (score[prev + 1] + behind[prev + 1])[:, None, :], axis=2)
        total = np.logaddexp.reduce(ahead + behind, axis=1)
        prob = np.exp(ahead + behind - total[:, None])
        unary = lines_.features.T @ (labels - prob[:, 1])
        moves = np.zeros((2, 2))
        inner = np.ones(len(score), bool)
        inner[lines_.of[:-1][np.diff(lines_.of) > 0]] = False
        at = np.flatnonzero(inner)
        pair = np.exp(ahead[at - 1][:, :, None] + self.moves + (score[at] + behind[at])[:, None, :] - total[at][:, None, None])
        np.add.at(moves, (labels[at - 1], labels[at]), 1)
        return unary, moves - pair.sum(0)


def first_labels(parts: Lines, labels: np.ndarray) -> np.ndarray:
    """Content are the lines of good documents, but those that are repeated while the others aren't."""
    return np.repeat(labels, np.diff(parts.of)) * (parts.features[:, ALONE] <= 0.5)


def held_to(parts: Lines, y: np.ndarray, score: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The labels y, with the fewest words changed by score so that a good document is content for the most part, and a bad one isn't."""
    y = y.copy()
    for d in np.flatnonzero(np.diff(parts.of)):
        at = np.arange(parts.of[d], parts.of[d + 1])
        words = parts.words[at].astype(float)
        share, good = (words * y[at]).sum() / words.sum(), labels[d] > 0
        if good == (share >= CONTENT_SHARE):
            continue
        order = np.argsort(-score[at] if good else score[at], kind="stable")  # surest lines of the wanted label first
        order = order[y[at][order] != good]
        moved = np.cumsum(words[order]) / words.sum()
        lacking = CONTENT_SHARE - share if good else share - CONTENT_SHARE
        y[at[order[: int(np.searchsorted(moved, lacking, "left" if good else "right")) + 1]]] = good
    return y


def climb(field: Field, parts: Lines, y: np.ndarray, decay: float = 1e-4) -> None:
    """STEPS steps of AdaGrad up the likelihood of the lines' labels."""
    seen = [np.full(field.unary.shape, 1e-8), np.full((2, 2), 1e-8)]
    for _ in range(STEPS):
        for w, g, s in zip((field.unary, field.moves), field.gradient(parts, y), seen, strict=True):
            g = g / len(y) - decay * w
            s += g * g
            w += 0.5 * g / np.sqrt(s)


def train(parts: Lines, labels: np.ndarray, repeated: np.ndarray | None = None) -> Field:
    """A field fitted to documents' lines and labels; without any line all is content."""
    field = Field(np.zeros(len(FEATURES)), np.zeros((2, 2)), repeated)
    if not len(parts.features):
        field.unary[0] = 1.0
        return field
    y = held_to(parts, first_labels(parts, labels), np.zeros(len(parts.features)), labels)
    climb(field, parts, y)
    for _ in range(TURNS - 1):
        y = held_to(parts, field.viterbi(parts).astype(np.int64), parts.features @ field.unary, labels)
        climb(field, parts, y)
    return field


def repeated_lines(docs: DataFrame) -> np.ndarray:
    """Hashes of the repeated lines of all of docs(text), ascending: REPEATED of them at most."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                w = Words.of_column(texts)
                starts, ends, _ = line_spans(w)
                owner = np.searchsorted(w.offs, starts, "right") - 1
                each = pd.DataFrame({"line": span_hashes(w.data, starts, ends, fold=False).view(np.int64), "doc": owner}).drop_duplicates()
                n = each.groupby("line").size()
                yield pa.RecordBatch.from_arrays([pa.array(n.index.to_numpy(np.int64)), pa.array(n.to_numpy(np.int64))], ["line", "n"])

    counted = pick(docs, "text").filter("text is not null").mapInArrow(run, "line long, n long")
    counted = counted.groupBy("line").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    every = stored(counted, "lines")
    total = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = every.filter(F.col("n") * REPEATED >= total).collect()
    return np.sort(np.array([r.line for r in rows], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Field:
    """Train on at most ``most`` labelled documents outside the held-out fold, those of the least hash of doc_id."""
    repeated = repeated_lines(docs)
    sent = docs.sparkSession.sparkContext.broadcast(repeated)

    def make(texts: pa.Array, ids: list[int]) -> list[bytes]:
        got = lines(texts, sent.value)
        out = []
        for d, i in enumerate(ids):
            a, b = int(got.of[d]), int(got.of[d + 1])
            a += hash(i) % (b - a - TRAIN_LINES + 1) if b - a > TRAIN_LINES else 0
            b = min(b, a + TRAIN_LINES)
            out.append(np.concatenate([got.words[a:b, None], got.features[a:b]], 1).astype(np.float32).tobytes())
        return out

    rows = features(sample(docs, labels, "quality", most), make)
    each = [np.frombuffer(x, np.float32).reshape(-1, 1 + len(FEATURES)).astype(float) for x, _ in rows]
    every = np.concatenate([np.zeros((0, 1 + len(FEATURES))), *each])
    of = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return train(Lines(np.zeros((len(rows), 0)), every[:, 1:], every[:, 0], of), np.array([y for _, y in rows], np.int64), repeated)


def judge(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",), share: float = CONTENT_SHARE, text: str = "text") -> DataFrame:
    """The kept columns, the counts, content_share, base_failed and kept of every row of docs.

    Null and empty texts have no words and fail. Rows are judged one by one, so
    repeated rows and null ids stay. Other columns are dropped, whatever their names.
    """
    ship(docs.sparkSession)
    at = keep.index(text) if text in keep else len(keep)
    docs = pick(docs, *keep, *(() if text in keep else (text,)))
    extra = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("content_share", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields[: len(keep)], *extra])
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in pieces(batch.column(at)):
                got = lines(texts, sent.value.repeated)
                content = got.words * sent.value.viterbi(got)
                total = np.concatenate([[0], np.cumsum(content)])
                part = np.diff(total[got.of]) / np.maximum(got.counts[:, 0], 1)
                arrays = [batch.column(i).slice(a, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c) for c in got.counts.T], pa.array(part)], schema.names)

    out = docs.mapInArrow(run, schema)
    out = out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= share))


def retained(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of docs that are kept, with all their columns as they were, whatever their names."""
    plain = numbered(docs)
    judged = judge(plain, field, tuple(plain.columns), text=plain.columns[docs.columns.index("text")])
    return judged.filter("kept").select(*plain.columns).toDF(*docs.columns)
