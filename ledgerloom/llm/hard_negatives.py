"""Hard negatives by vector-approximation files.

Anchors meet rows block by block: each task gets one block of anchors and one of rows. It
quantises every dimension of its rows into CELLS cells and keeps, per dimension, the least
and the greatest value of each cell. For an anchor, a table gives each cell's least and
greatest contribution to the inner product, so the bounds of all rows' scores are sums of
table lookups. Only rows whose bounds may put them among the nearest, or into a window
and among its first, are scored exactly, in integers.

1. Positives: anchors and rows of one label, which is dealt into blocks if it is large.
2. Negatives: anchors with their positives' windows, and all rows. A task sends on the
   first rows of each window only; Spark ranks them.

Blocks are of bounded size, so no task grows with the table, and nothing is broadcast by
hand or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import discard, pick, ship, stored

CELLS = 64
ANCHORS, ROWS = 512, 8192
#: A null id, last among equal scores.
LAST = 2**63 - 1


def quantised(scale: int):
    """id, embedding, label -> id, label, d, v: floor(scale * x) of rows whose components are all finite, as 16- or 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, at = batch.column(1), []
            sizes = pa.compute.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
            flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
            ends = np.cumsum(sizes)
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(flat * scale)
            fine = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            valid = vectors.is_valid().to_numpy(zero_copy_only=False) & (fine[ends] == fine[ends - sizes])
            out = []
            for i in np.flatnonzero(valid):
                v = whole[ends[i] - sizes[i] : ends[i]]
                most = np.abs(v).max(initial=0)
                if most >= 2**31:
                    raise ValueError("a component's integer needs more than 32 bits")
                at.append(i)
                out.append(v.astype(np.int16 if most < 2**15 else np.int32).tobytes())
            kept = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(2).take(kept), pa.array(sizes[at].astype(np.int32)), pa.array(out, pa.binary())], ["id", "label", "d", "v"])

    return run


def matrix(d: np.ndarray, v: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of int64; missing components are zero."""
    out = np.zeros((len(d), width), np.int64)
    for i, (n, raw) in enumerate(zip(d.tolist(), v.to_pylist(), strict=True)):
        out[i, :n] = np.frombuffer(raw, np.int16 if len(raw) == 2 * n else np.int32)
    return out


def scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products; refused if one may not fit in 64 bits."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor))
    if most < 2**53:
        return (rows.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    if most >= 2**63:
        raise ValueError("a score may need more than 64 bits")
    return rows @ anchor


class Approximation:
    """A block of integer vectors, each dimension quantised into cells between its least and greatest value."""

    def __init__(self, rows: np.ndarray, cells: int = CELLS):
        self.rows = rows
        n, d = rows.shape
        least, most = (rows.min(0), rows.max(0)) if n else (np.zeros(d, np.int64), np.zeros(d, np.int64))
        width = (most - least) // cells + 1
        self.codes = np.ascontiguousarray(((rows - least) // width).T)
        #: Least and greatest value of each cell, by dimension.
        self.low = least[:, None] + np.arange(cells) * width[:, None]
        self.high = np.minimum(self.low + width[:, None] - 1, most[:, None])
        self.low = np.minimum(self.low, most[:, None])

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of all rows' scores, by table lookup."""
        a, b = self.low * anchor[:, None], self.high * anchor[:, None]
        low, high = np.minimum(a, b), np.maximum(a, b)
        n = self.codes.shape[1]
        if int(np.abs(low).max(initial=0) + np.abs(high).max(initial=0)) * len(anchor) < 2**31:
            table, both = (high << 32) + low, np.zeros(n, np.int64)  # one lookup for both
            for t, codes in zip(table, self.codes, strict=True):
                both += t.take(codes)
            lower = (both << 32) >> 32
            return lower, (both - lower) >> 32
        lower, upper = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for x, y, codes in zip(low, high, self.codes, strict=True):
            lower += x.take(codes)
            upper += y.take(codes)
        return lower, upper


def first(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by id."""
    return np.lexsort((ids, -score))[:most]


def kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest value, if there are as many."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def _sides(table: pa.Table) -> tuple[dict, dict, Approximation]:
    anchor = table.column("anchor").to_numpy(zero_copy_only=False)
    out = []
    width = int(pa.compute.max(table.column("d")).as_py() or 0)
    for mask in (anchor, ~anchor):
        part = table.filter(pa.array(mask))
        ids = part.column("id").combine_chunks()
        cols = {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "label", "d")}
        out.append(cols | {"ids": ids, "order": ids.fill_null(LAST).to_numpy(zero_copy_only=False), "table": part, "m": matrix(cols["d"], part.column("v").combine_chunks(), width)})
    return out[0], out[1], Approximation(out[1]["m"])


def _positives(most: int):
    """One block of anchors and one of rows of a label -> each anchor's first ``most`` other rows of the block."""

    def run(table: pa.Table) -> pa.Table:
        anchors, rows, file = _sides(table)
        who, hit, score = [], [], []
        for i, a in enumerate(anchors["m"]):
            lower, upper = file.bounds(a)
            other = rows["uid"] != anchors["uid"][i]
            least = kth(lower[other], most)
            may = np.flatnonzero(other if least is None else other & (upper >= least))
            s = scores(rows["m"][may], a)
            best = first(s, rows["order"][may], most)
            who += [i] * len(best)
            hit.append(may[best])
            score.append(s[best])
        hit, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (hit, score))
        return pa.table({"anchor_uid": pa.array(anchors["uid"][who], pa.int64()), "positive_id": rows["ids"].take(pa.array(hit)), "positive_score": pa.array(score)})

    return run


def _negatives(most: int, low: int, high: int):
    """One block of anchors with their positives and one of rows -> the first ``most`` rows of the block in each window."""

    def run(table: pa.Table) -> pa.Table:
        anchors, rows, file = _sides(table)
        positives = anchors["table"].column("positives").to_pylist()
        who, which, hit, score = [], [], [], []
        for i, a in enumerate(anchors["m"]):
            lower, upper = file.bounds(a)
            other = rows["label"] != anchors["label"][i]
            lower, upper, places = lower[other], upper[other], np.flatnonzero(other)
            windows, may = {}, np.zeros(len(places), bool)
            for p in {p["positive_score"] for p in positives[i]}:
                floor, top = -((-low * p) // 100), high * p // 100
                windows[p] = floor, top
                if floor > top:
                    continue
                sure = lower[(lower >= floor) & (upper <= top)]
                least = kth(sure, most)
                may |= (upper >= (floor if least is None else max(floor, least))) & (lower <= top)
            places = places[may]
            s, order = scores(rows["m"][places], a), rows["order"][places]
            by = first(s, order, len(s))
            for q, p in enumerate(positives[i]):
                floor, top = windows[p["positive_score"]]
                best = by[(s[by] >= floor) & (s[by] <= top)][:most]
                who += [i] * len(best)
                which += [q] * len(best)
                hit.append(places[best])
                score.append(s[best])
        hit, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (hit, score))
        of = [positives[i][q] for i, q in zip(who, which, strict=True)]
        return pa.table(
            {
                "anchor_uid": pa.array(anchors["uid"][who], pa.int64()),
                "anchor_id": anchors["ids"].take(pa.array(who, pa.int64())),
                "place": pa.array(which, pa.int32()),
                "positive_id": pa.array([p["positive_id"] for p in of], pa.int64()),
                "positive_score": pa.array([p["positive_score"] for p in of], pa.int64()),
                "negative_id": rows["ids"].take(pa.array(hit)),
                "negative_score": pa.array(score),
            }
        )

    return run


def _pieces(n: str, size: int) -> Column:
    return F.expr(f"cast(({n} + {size - 1}) div {size} as int)")


def _dealt(anchors: DataFrame, rows: DataFrame, x_blocks: Column, y_blocks: Column, extra: list[str]) -> DataFrame:
    """Every block x of anchors beside every block y of rows, marked by ``anchor``."""
    own = lambda n: F.pmod(F.xxhash64("uid"), n.cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    columns = ["uid", "id", "label", "d", "v"]
    a = anchors.select(own(x_blocks).alias("x"), each(y_blocks).alias("y"), F.lit(True).alias("anchor"), *columns, *extra)
    r = rows.select(each(x_blocks).alias("x"), own(y_blocks).alias("y"), F.lit(False).alias("anchor"), *columns)
    return a.unionByName(r, allowMissingColumns=True)


def mine(
    vectors: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    block: int = ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from vectors(vec_id, embedding, label).

    Anchors are rows whose vec_id is divisible by ``every``. Scores are inner products of
    floor(scale * x); higher ones come first, ties by smaller vec_id. An anchor's first
    other rows of its label are its positives; for each of them, the first rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score are
    returned, ranked from 1. A positive without any has no row.

    Rows with a null label or vector, or a component that is null or not finite, take no
    part. A null vec_id is no anchor's and comes last among ties. Rows that repeat, even a
    vec_id, are rows of their own: a repeated anchor is an anchor twice, and each is the
    other's positive. A shorter vector counts as ending in zeros. Integers beyond 32 bits a
    component or 64 a score are refused. Other columns are ignored; an empty table gives an
    empty result.
    """
    ship(vectors.sparkSession)
    plain = pick(vectors, "vec_id", "embedding", "label").toDF("id", "embedding", "label").filter("label is not null and embedding is not null")
    plain = plain.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    rows = plain.mapInArrow(quantised(scale), "id long, label long, d int, v binary")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("uid"), "*"), "vectors")
    anchors = rows.filter(F.col("id") % every == 0)

    sizes = rows.groupBy("label").agg(F.count_if(F.col("id") % every == 0).alias("a"), F.count(F.lit(1)).alias("n")).filter("a > 0")
    sizes = stored(sizes.select("label", _pieces("a", ANCHORS).alias("x_blocks"), _pieces("n", block).alias("y_blocks")), "sizes")
    near = _dealt(anchors.join(sizes, "label"), rows.join(sizes, "label"), F.col("x_blocks"), F.col("y_blocks"), []).groupBy("label", "x", "y").applyInArrow(_positives(positives), "anchor_uid long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_uid").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last())
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    near = near.groupBy("anchor_uid").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    ready = stored(anchors.join(near, anchors["uid"] == near["anchor_uid"]).drop("anchor_uid"), "anchors")

    n, a = rows.count(), ready.count()
    met = _dealt(ready, rows, F.lit(max(1, -(-a // ANCHORS))), F.lit(max(1, -(-n // block))), ["positives"])
    schema = "anchor_uid long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
    found = met.groupBy("x", "y").applyInArrow(_negatives(negatives, low, high), schema)
    order = Window.partitionBy("anchor_uid", "place").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    out = stored(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(rows, sizes, ready)
    return out
