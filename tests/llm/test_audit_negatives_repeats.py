"""The filter audit, hard negatives and suffix deduplication against brute-force versions and rows made to break them."""

from __future__ import annotations

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import filter_audit, hard_negatives, suffix_dedup

WORD = r"[^\x20\x09-\x0D]+"


# filter audit


def audit_by_hand(rows, labels):
    """(part, order, step) -> figures, each document walked through each order."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    facts = []
    for d, text, source in rows:
        t = text or ""
        words = re.findall(WORD, t)
        fails = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search(r"[#$%&*|]", t)),
            any(e is not None and d is not None and e < d and (x or "") == t for e, x, _ in rows),
        ]
        facts.append((source or "", dict(zip("ABCDE", fails, strict=True)), d in good, d in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                shapley[x] += len(gone)
                redundant = sum(f[1][x] for f in own) - len(gone)
                alone = sum(f[1][x] and sum(f[1].values()) == 1 for f in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # columns that the operator makes itself, or that differ from its own in case only
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("A", "part", "digest", "first", "good", "TEXT")])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("E", F.lit(1))
    got = filter_audit.audit_documents(docs, marks).collect()
    out = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def test_audit_equals_a_walk_through_every_order(spark):
    rng = random.Random(5)
    base = ["w%d" % i for i in range(400)]
    rows = [(1, None, "a"), (2, "", None), (3, "", "a"), (None, "", ""), (None, None, "a"), (7, "same", "b"), (7, "same", "b"), (8, "same", "c"), (9, "Ab " * 30_000, "a")]
    for i in range(10, 90):
        words = rng.choices(base[: rng.choice([5, 60, 400])], k=rng.choice([3, 199, 200, 260]))
        words += rng.choice([[], ["A"], ["ABCDEFGHIJK"] * 5, ["é\x85#"], ["|"]])
        rows.append((i, rng.choice([" ", "\n", "\t\x0b"]).join(words) if rng.random() < 0.8 else "copied", rng.choice(["a", "b", None, "", "d'é"])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(5, 60)] + [(10, 1, 0), (10, 0, 1), (None, 1, 1), (5000, 1, 1)]
    want = audit_by_hand(rows, labels)
    assert audited(spark, rows, labels) == want


def test_audit_of_an_empty_table_and_without_labels(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    rows = [(1, "one", "a"), (2, "one", "a")]
    assert audited(spark, rows, []) == audit_by_hand(rows, [])


def test_a_hot_text_and_a_hot_source(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i % 50}", "hot" if i % 3 else f"s{i % 40}") for i in range(2000)]
    got = audited(spark, rows, [])
    assert got["hot", "EABCD", 1][1] == sum(1 for i in range(2000) if i % 3 and any(j < i and (j % 3 == 0) == (i % 3 == 0) and j % 50 == i % 50 and j % 3 for j in range(i)))
    assert len(got) == 600 * len({r[2] for r in rows})


def test_bitmaps_count_by_part_and_subset():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000):
        part = rng.integers(0, 7, n)
        bits = [rng.random(n) < 0.4 for _ in range(3)]
        names, counts = filter_audit.subset_counts(part, bits[:2], bits[2:])
        for p, c in zip(names, counts, strict=True):
            for s in range(4):
                left = (part == p) & ~((bits[0] & bool(s & 1)) | (bits[1] & bool(s & 2)))
                assert c[s].tolist() == [left.sum(), (left & bits[2]).sum()]


def test_too_many_filters_are_refused(spark):
    with pytest.raises(ValueError):
        filter_audit.audit(spark.range(1), "id", [str(i) for i in range(8)], [])


# hard negatives


def negatives_by_hand(rows, every=100, positives=5, negatives=10, low=30, high=90):
    fine = []
    for k, (i, v, label) in enumerate(rows):
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((k, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, i, v, label in fine:
        if i is None or i % every:
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=False)), j, m == label) for q, j, w, m in fine if q != k]
        score.sort(key=lambda x: (-x[0], last(x[1])))
        for p in [x for x in score if x[2]][:positives]:
            window = [x for x in score if not x[2] and low * p[0] <= 100 * x[0] <= high * p[0]]
            out += [(i, p[1], r, x[1], p[0], x[0]) for r, x in enumerate(window[:negatives], 1)]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("id", "uid", "v", "anchor", "LABEL", "rank")])
    return sorted((tuple(r) for r in hard_negatives.mine(df, **more).collect()), key=str)


def vectors(seed, n, labels=4, d=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, d))
    out = []
    for i in range(n):
        x = middle[i % labels] + rng.normal(size=d) * 0.8
        out.append((i, [round(float(c), 3) for c in x / np.linalg.norm(x)], i % labels))
    return out


@pytest.mark.parametrize("block", [16, 8192])
def test_negatives_equal_all_scores(spark, block):
    rows = vectors(1, 700)
    assert mined(spark, rows, every=20, block=block) == negatives_by_hand(rows, every=20)


def test_negatives_of_odd_rows(spark):
    v = [0.5, -0.25, 0.125]
    rows = [(0, v, 1), (0, v, 1), (100, v, 1), (101, v, 1), (101, v, 2), (102, v, None), (103, None, 1), (104, [0.5, None, 0.1], 1), (105, [float("nan"), 0.0, 0.0], 2), (106, [float("inf"), 0.0, 0.0], 2)]
    rows += [(None, [0.4, -0.2, 0.1], 2), (None, [0.4, -0.2, 0.1], 2), (107, [0.4, -0.2, 0.1], 2), (108, [0.4], 2), (109, [], 2), (200, [0.0, 0.0, 0.0], 3), (201, [0.0, 0.0, 0.0], 3), (300, [-1.0, 0.0, 0.0], 4), (301, [1.0, 0.0, 0.0], 4), (400, v, 9)]
    rows += [(110, [300.0, 0.1, 0.2], 5), (111, [0.3, 0.2, 0.1], 5), (500, [250.0, 1.0, -3.0], 5)]
    assert mined(spark, rows) == negatives_by_hand(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, v, 1), (2, v, 2)]) == []


def test_equal_scores_go_by_id_and_hot_labels_are_dealt(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.5, 0.5], 0 if i % 3 else i % 5) for i in range(900)]
    assert mined(spark, rows, block=64) == negatives_by_hand(rows)


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(Exception, match="32 bits"):
        mined(spark, [(0, [1e30], 1), (1, [1e30], 1)])


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    for spread in (3, 200, 30_000, 2**30):
        m = rng.integers(-spread, spread + 1, (500, 9))
        for cells in (2, 64):
            file = hard_negatives.Approximation(m, cells)
            for a in m[:20]:
                low, high = file.bounds(a)
                s = np.array([int(sum(int(x) * int(y) for x, y in zip(a, b, strict=True))) for b in m], object)
                assert (low <= s).all() and (s <= high).all()
                if spread == 3 and cells == 64:
                    assert (low == high).all()


# suffix deduplication


def repeats_by_hand(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if d is not None:
                first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = b"\x01" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(gone))]
        out.append((d, len(b), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def without_repeats(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("chunk", "pos", "bucket", "marks", "TEXT")])
    out = suffix_dedup.remove_repeats(df)
    got = sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])) for r in out.collect()), key=str)
    suffix_dedup.release(out)
    return got


def texts_with_repeats(seed, n):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(40)] + ["é", "漢字", "\n", "\x00", "aaaa"]
    shared = [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(12)]
    out = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        t = rng.choice([" ", "", "\n"]).join(parts)
        if rng.random() < 0.3 and t:
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice("xyz") + t[at + 1 :]
        out.append((i, t))
    return out


ODD = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 51), (6, "x" * 300), (6, "x" * 300), (7, "ab" * 120), (7, "ba" * 120), (9, "ab" * 24 + "c" + "ab" * 24), (None, "x" * 80), (None, "ab" * 60), (10, "\x00" * 70), (11, "a" + "\x00" * 70), (12, "é" * 30), (13, "aé" + "é" * 30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_all_strings(spark, seed):
    rows = texts_with_repeats(seed, 150) + ODD
    random.Random(seed).shuffle(rows)
    assert without_repeats(spark, rows) == repeats_by_hand(rows)


def test_small_chunks_slices_and_hot_strings(spark, monkeypatch):
    """The same with many chunks and buckets, one slice a string, and every common string hot; tasks fork after the change."""
    rows = texts_with_repeats(3, 120) + ODD
    for name, value in (("CHUNK", 2000), ("BUCKET", 1000), ("SLICE", 1), ("HOT", 3), ("SEGMENT", 700)):
        monkeypatch.setattr(suffix_dedup, name, value)
    data = [(d, t) for d, t in rows if d is not None]
    assert in_process(data) == [r for r in repeats_by_hand(data)]


def in_process(rows):
    """remove_repeats() without Spark: the same tasks, one after another."""
    chunks, size = [[]], 0
    for r in rows:
        n = len((r[1] or "").encode())
        if size and size + n > suffix_dedup.CHUNK:
            chunks.append([])
            size = 0
        chunks[-1].append(r)
        size += n
    tables = [pa.table({"chunk": [c] * len(x), "pos": pa.array(range(len(x)), pa.int32()), "doc_id": pa.array([r[0] for r in x], pa.int64()), "text": pa.array([r[1] for r in x], pa.string())}) for c, x in enumerate(chunks)]
    bits = max(1, (-(-sum(len((t or "").encode()) for _, t in rows) // suffix_dedup.BUCKET) - 1).bit_length())

    def by(table, key):
        return [table.filter(pa.compute.equal(table.column(key), v)) for v in sorted(set(table.column(key).to_pylist()))]

    strings = pa.concat_tables([suffix_dedup._strings(bits)(t) for t in tables])
    verdicts = pa.concat_tables([suffix_dedup._judged(t) for t in by(strings, "bucket")])
    records = pa.concat_tables([suffix_dedup._records(bits)(t, verdicts.filter(pa.compute.equal(verdicts.column("chunk"), c))) for c, t in enumerate(tables)])
    marks = pa.concat_tables([suffix_dedup._sorted(t) for t in by(records, "bucket")])
    assert len(set(records.column("bucket").to_pylist())) > 4
    out = pa.concat_tables([suffix_dedup._cut(t, marks.filter(pa.compute.equal(marks.column("chunk"), c))) for c, t in enumerate(tables)]).to_pylist()
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["stop"]) for s in r["spans"]], r["kept"]) for r in out), key=str)


def test_empty_table_and_no_repeats(spark):
    assert without_repeats(spark, []) == []
    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(40)]
    assert without_repeats(spark, rows) == repeats_by_hand(rows)


def test_one_template_and_one_copied_text_in_a_third_of_rows(spark):
    template = "This notice stands above a third of all the pages of this site, in the same words. "
    rows = [(i, template + "#%d " % i * 8 if i % 3 == 0 else "copied text " * 9 if i % 3 == 1 else "own text %d" % i * 9) for i in range(900)]
    assert without_repeats(spark, rows) == repeats_by_hand(rows)


def test_very_long_texts(spark):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh ", k=700_000))
    rows = [(1, long), (2, "z" * 600_000), (3, long[300_000:300_090] + "z" * 60), (4, long[::-1])]
    got = {r[0]: r for r in without_repeats(spark, rows)}
    assert got[1][2] == [] and got[2][2] == [] and got[4][2] == []
    assert got[3] == (3, 150, [(0, 150)], b"") or got[3][2] == [(0, 90), (90, 150)]


def test_cover_has_a_distance_for_all_residues():
    for a in range(suffix_dedup.PERIOD):
        for b in range(suffix_dedup.PERIOD):
            d = suffix_dedup.DISTANCE[a, b]
            assert suffix_dedup.ON_COVER[a + d] and suffix_dedup.ON_COVER[b + d]


def test_suffix_order_groups_whatever_stands_where():
    """Rows whose equal strings stand at different residues, so that ties are merged over the cover."""
    rng = random.Random(9)
    base = "".join(rng.choices("ab", k=90))
    rows = [base[i : i + rng.randint(50, 80)].encode() for i in range(30)] + [b"ab" * 40, b"ba" * 40, b"a" * 81]
    rows = [r for r in rows if len(r) >= 50]
    size = np.array([len(r) for r in rows])
    begin = np.array([rng.randint(1, 31) for _ in rows])
    cells = suffix_dedup._laid(np.frombuffer(b"".join(rows), np.uint8), begin, size)
    docs = np.array([rng.randint(0, 99) for _ in rows])
    row, place, first = suffix_dedup.first_documents(cells, begin, size, docs)
    lowest = {}
    for r, p in zip(row, place, strict=True):
        s = rows[r][p : p + 50]
        lowest[s] = min(docs[r], lowest.get(s, 10**9))
    assert [lowest[rows[r][p : p + 50]] for r, p in zip(row, place, strict=True)] == first.tolist()
    at = row * suffix_dedup.WIDTH + begin[row] + place
    order = suffix_dedup.suffix_order(cells, begin, size, at)
    texts = [rows[row[i]][place[i] : place[i] + 50] for i in order]
    assert texts == sorted(texts)
