"""Hard negatives for pairs of an anchor and a positive, by distributed radix selection.

Scores are integer inner products of vectors whose components are floor(256 x); higher scores come first, ties by smaller
id.  An anchor's positives are its best rows of the same label.  Each pair of an anchor and a positive is a window of scores
(30 to 90 % of the positive's), and its negatives are the best rows of other labels inside it.

Both choices are one selection of the k best rows of each window.  A window's order is a number of two parts: the distance of
the score from the window's upper end, then the id.  Each round cuts the range that holds the kth row into 256 buckets; the
tasks count their rows by window and bucket, the counts are summed, and the bucket of the kth row is the next round's
range: first over distances, then, where more rows than ``SLACK`` share a score, over their ids.  In the end only rows up to
the located bucket are gathered, at most k + ``SLACK`` for each window.

Defined cases: rows with a null id, label, vector or component, or a component that is not finite, take no part; shorter
vectors count as filled up with zeros; scores beyond a long are cut to its range; of several rows with an anchor's id the
one of least label and vector is the anchor, and rows with its id are never its positives or negatives; other rows with one
id are separate rows, but a pair's ids and scores that come twice are one window; ties go to the smaller id; an anchor
without positives, or a window without rows, gives no rows; other columns aren't read; an empty table gives an empty result.

Plan: anchors are a stated part of the rows (ids divisible by 100), so the work is anchors times rows by definition.  They are
taken in slices of ``SLICE`` anchors, whose vectors, windows and bounds are what is sent at once; each round of a slice
is a scan in which a task multiplies blocks of rows with the slice.  A task drops its buckets behind its own kth row, which
can't hold the kth row of all, so it emits at most k buckets of a window, however many rows equal each other.  Nothing is
shuffled by label, so no label can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.lineage import Scratch, checkpointed

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
SHARES = (30, 90)  # per cent of the positive's score
ANCHOR_STEP = 100
MOVED, LABELS = 7, 10  # ids divisible by the first get the next label of so many
SLICE = 1024  # anchors sent at once, on average: 0.5 MB at 64 components, and up to five windows of 64 bytes each
SLACK = 64
_BUCKETS = 256
_ROWS = 512  # rows multiplied with a slice at a time
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_LAST = (1 << 64) - 1
_EXACT = float(1 << 52)
_SIGN = np.uint64(1 << 63)


def block(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, moved labels and whole components of the rows of ``vec_id, label, embedding`` that take part."""
    ids, labels, vectors = batch.columns
    here = np.array(ids.is_valid()) & np.array(labels.is_valid()) & np.array(vectors.is_valid()) if batch.num_rows else np.zeros(0, bool)
    batch = batch.filter(pa.array(here))
    ids, labels, vectors = batch.columns
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)  # null components become NaN
    wide = np.zeros((len(lengths), int(lengths.max(initial=0))))
    wide[np.arange(wide.shape[1]) < lengths[:, None]] = flat
    fine = np.isfinite(wide).all(axis=1)
    ids, labels = ids.to_numpy()[fine].astype(np.int64), labels.to_numpy()[fine].astype(np.int64)
    return ids, np.where(ids % MOVED == 0, (labels + 1) % LABELS, labels), np.floor(SCALE * wide[fine])


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products as longs; products of doubles where they are exact, else whole numbers of any size, cut to a long."""
    n = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :n], anchors[:, :n]
    if not rows.size or not anchors.size:
        return np.zeros((len(rows), len(anchors)), np.int64)
    if np.abs(rows).max() * np.abs(anchors).sum(axis=1).max() < _EXACT:
        return (rows @ anchors.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.array([[min(max(x, _LOW), _HIGH) for x in r] for r in whole(rows) @ whole(anchors).T], np.int64)


class Windows:
    """Windows of one slice: anchors, bounds of scores, and what is located so far of each window's kth row."""

    def __init__(self, slice_: dict, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.slice, self.anchor, self.same, self.k = slice_, anchor, same, k
        self.low, self.high = low.astype(np.int64), high.astype(np.int64)
        n = len(anchor)
        self.near, self.far = np.zeros(n, np.uint64), self.high.view(np.uint64) - self.low.view(np.uint64)  # distances from the upper end
        self.first, self.last = np.zeros(n, np.uint64), np.full(n, _LAST, np.uint64)  # ids at the farthest distance
        self.need, self.done = np.full(n, k, np.int64), self.low > self.high
        self.empty = self.done.copy()

    def _hits(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, chosen: np.ndarray, near: np.ndarray):
        """Rows and windows, among the chosen ones, whose distance is in the range; with distances and ids."""
        anchor, high = self.anchor[chosen], self.high[chosen]
        s = scores(rows, self.slice["v"])[:, anchor]
        top = (high.view(np.uint64) - near).view(np.int64)
        bottom = (high.view(np.uint64) - self.far[chosen]).view(np.int64)
        like = labels[:, None] == self.slice["label"][anchor]
        fits = (s <= top) & (s >= bottom) & (like == self.same) & (ids[:, None] != self.slice["vec_id"][anchor])
        r, w = np.nonzero(fits)
        found = s[r, w]
        return r, chosen[w], found, high.view(np.uint64)[w] - found.view(np.uint64), ids.view(np.uint64)[r] ^ _SIGN

    def width(self) -> np.ndarray:
        """Of a bucket: a 256th of the range of distances, or of ids where one distance is left."""
        one = self.near == self.far
        span = np.where(one, self.last - self.first, self.far - self.near)
        return span // np.uint64(_BUCKETS) + np.uint64(1)

    def counts(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows by open window and bucket of its range."""
        chosen = np.flatnonzero(~self.done)
        place = np.zeros(len(self.anchor), np.int64)
        place[chosen] = np.arange(len(chosen))
        r, w, _, d, u = self._hits(ids, labels, rows, chosen, self.near[chosen])
        one = (self.near == self.far)[w]
        inside = ~one | (u >= self.first[w]) & (u <= self.last[w])
        w, d, u, one = w[inside], d[inside], u[inside], one[inside]
        bucket = np.where(one, u - self.first[w], d - self.near[w]) // self.width()[w]
        return np.bincount(place[w] * _BUCKETS + bucket.astype(np.int64), minlength=len(chosen) * _BUCKETS).reshape(len(chosen), _BUCKETS)

    def located(self, found: dict[int, tuple[int, int, int]]) -> None:
        """Takes window -> (bucket, rows up to it, rows in it) of the bucket that holds the kth row; a window that isn't
        there has fewer rows."""
        width, one = self.width(), self.near == self.far
        for w in np.flatnonzero(~self.done):
            if int(w) not in found:
                self.done[w] = True
                continue
            bucket, upto, n = found[int(w)]
            low, high = (self.first, self.last) if one[w] else (self.near, self.far)
            start = int(low[w]) + bucket * int(width[w])
            low[w], high[w] = start, min(start + int(width[w]) - 1, int(high[w]))
            self.need[w] -= upto - n
            self.done[w] = n <= self.need[w] + SLACK or bool(one[w]) and int(low[w]) == int(high[w])

    def gathered(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        """Window, score and id of the rows up to the located bucket."""
        chosen = np.flatnonzero(~self.empty)
        r, w, s, d, u = self._hits(ids, labels, rows, chosen, np.zeros(len(chosen), np.uint64))
        qualify = (d < self.far[w]) | (u <= self.last[w])
        return w[qualify], s[qualify], ids[r[qualify]]


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            got = block(batch.slice(i, _ROWS))
            if len(got[0]):
                yield got


def _locate(rows: DataFrame, windows: Windows) -> None:
    """Digit by digit, until each window's kth row lies in a small bucket."""
    context = rows.sparkSession.sparkContext
    while not windows.done.all():
        sent = context.broadcast(windows)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            chosen, total = np.flatnonzero(~own.done), None
            for got in _blocks(batches):
                counts = own.counts(*got)
                total = counts if total is None else total + counts
            if total is None:
                return
            before = total.cumsum(axis=1) - total
            w, bucket = np.nonzero((total > 0) & (before < own.need[chosen][:, None]))
            arrays = [pa.array(chosen[w]), pa.array(own.need[chosen[w]]), pa.array(bucket), pa.array(total[w, bucket])]
            yield pa.RecordBatch.from_arrays(arrays, names=["w", "need", "bucket", "n"])

        sums = rows.mapInArrow(count, "w long, need long, bucket long, n long").groupBy("w", "need", "bucket").agg(F.sum("n").alias("n"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("w").orderBy("bucket")))
        at = upto.where("upto >= need AND upto - n < need").collect()  # a row for each window of the slice at most
        windows.located({r["w"]: (r["bucket"], r["upto"], r["n"]) for r in at})
        sent.unpersist()


def _best(rows: DataFrame, windows: Windows) -> DataFrame:
    """``w, rank, vec_id, score``: the best k rows of each window, in order."""
    _locate(rows, windows)
    sent = rows.sparkSession.sparkContext.broadcast(windows)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _blocks(batches):
            w, s, ids = sent.value.gathered(*got)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(ids), pa.array(s)], names=["w", "vec_id", "score"])

    order = Window.partitionBy("w").orderBy(F.desc("score"), "vec_id")
    return rows.mapInArrow(gather, "w long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.k)


def anchors_of(rows: DataFrame, step: int = ANCHOR_STEP) -> DataFrame:
    """``vec_id, label, v`` of the anchors."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, v in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["vec_id", "label", "v"])

    known = rows.where(F.col("vec_id") % step == 0).mapInArrow(whole, "vec_id long, label long, v array<double>")
    return known.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def _longest(rows: DataFrame) -> float:
    """The largest length of a vector."""

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = max((float(np.sqrt((v * v).sum(axis=1)).max()) for _, _, v in _blocks(batches)), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([top])], names=["n"])

    return rows.mapInArrow(norm, "n double").agg(F.max("n")).first()[0] or 0.0


def _long(x: float) -> int:
    return int(x) if x < 9.2e18 else _HIGH


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", step: int = ANCHOR_STEP, slice_: int = SLICE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    anchors = checkpointed(anchors_of(rows, step))
    n_slices = -(-anchors.count() // slice_)
    longest = _longest(rows) if n_slices else 0.0
    folder, written = Scratch(spark).top, False
    for i in range(n_slices):
        got = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_slices)) == i).orderBy("vec_id").collect()
        found = _slice(rows, got, longest)
        if found is not None:
            found.write.mode("append").parquet(folder)
            written = True
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(folder) if written else spark.createDataFrame([], schema)


def _slice(rows: DataFrame, got: list, longest: float) -> DataFrame | None:
    """The results of the anchors of one slice; None if they have no positives."""
    if not got:
        return None
    v = np.zeros((len(got), max(len(r["v"]) for r in got)))
    for i, r in enumerate(got):
        v[i, : len(r["v"])] = r["v"]
    own = {"vec_id": np.array([r["vec_id"] for r in got], np.int64), "label": np.array([r["label"] for r in got], np.int64), "v": v}
    # no score exceeds the product of the lengths; one is added for rounding, and a part in 2**40
    reach = np.array([_long(x * longest * (1 + 2**-40) + 1) for x in np.sqrt((v * v).sum(axis=1))], np.int64)
    every = Windows(own, np.arange(len(got)), np.where(reach == _HIGH, _LOW, -reach), reach, True, POSITIVES)
    pairs = sorted({(r["w"], r["vec_id"], r["score"]) for r in _best(rows, every).collect()})  # POSITIVES of each anchor at most
    if not pairs:
        return None
    w, positive, score = (list(x) for x in zip(*pairs, strict=True))
    low = np.array([-(-SHARES[0] * s // 100) for s in score], np.int64)
    high = np.array([min(SHARES[1] * s // 100, _HIGH) for s in score], np.int64)
    keys = [(int(own["vec_id"][a]), p, s) for a, p, s in pairs]
    best = _best(rows, Windows(own, np.array(w), low, high, False, NEGATIVES))
    named = rows.sparkSession.createDataFrame([(i, *k) for i, k in enumerate(keys)], "w long, anchor_id long, positive_id long, positive_score long")
    return best.join(F.broadcast(named), "w").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
