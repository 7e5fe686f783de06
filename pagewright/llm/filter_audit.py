"""How five text filters interact in every order: a table of first failures, indexed per document.

A document's failures are a mask of five bits.  Row ``mask`` of a table of 32 x 120 cells holds, for each of the 120 orders
of the filters, the step at which such a document is removed (5: never).  Tasks index that table with the masks of a batch
and count (part, order, step, label) with ``bincount``; the partial arrays of the tasks are summed, and the report follows
from the sums.

Filters: A under 100 words; B under 80 % distinct words; C over 10 % letters A-Z; D one of ``#$%&*|``; E the text of a row
with a smaller id.

Defined cases: a null text is empty, and empty texts are identical to each other; a null language is the part ``''``; rows
of one id are separate rows, none of which is smaller than the other; a row without an id has no smaller one, is smaller than
none and has no labels; a document with several label rows is good (toxic) if one of them says so; texts of any length are
read whole; columns beyond those named aren't read; an empty table gives an empty report.

Plan: the corpus is scanned once, to a slim row of id, part, mask and a hash of 128 bits for each document.  What a text
fails but for E is the same in all its copies, so copies are counted by (text, part, labels) with partial sums in the scan's
own tasks; only these counts meet by text, at most one row for each part and label.  No group of copies meets in one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
LABELS = 4  # good + 2 * toxic
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = frozenset(b"#$%&*|")
_INNER = bytes(range(0x80, 0xC0))  # bytes inside a code point
_SLICE = 1_000  # rows turned into Python values at a time
_PARTS = 1_000  # parts whose arrays a task holds before it hands them on
# cells of a part's array: removals by order, step and label, then failures and lone failures by filter, then rows
_REMOVED = len(ORDERS) * (STEPS + 1) * LABELS
_CELLS = _REMOVED + 2 * STEPS + 1


def first_failures() -> np.ndarray:
    """Step of the first failure by mask and order; ``STEPS`` if the mask fails nothing."""
    ranks = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])  # order, step -> filter
    fails = (np.arange(1 << STEPS)[:, None, None] >> ranks) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), STEPS)


def failures(data: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    words = data.split()
    points, upper = len(data.translate(None, _INNER)), len(data) - len(data.translate(None, _UPPER))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * upper > 10 * points) << 2 | (not _SYMBOLS.isdisjoint(data)) << 3


def _halves(data: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(data)
    return tuple(int(x) for x in np.array([value >> 64, value & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, mask, high, low`` of each row: what its text fails but for E, and the text's hash."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, _SLICE) for whole in batches for i in range(0, whole.num_rows, _SLICE)):
            data = [x or b"" for x in batch.column(2).to_pylist()]
            high, low = zip(*map(_halves, data), strict=True) if data else ((), ())
            arrays = [pa.array(list(map(failures, data)), pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "part", "mask", "high", "low"])

    slim = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("p"), F.col(text_col).cast("binary").alias("t"))
    return slim.mapInArrow(judge, "doc_id long, part string, mask int, high long, low long")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, mask, label, n``: rows by part, all failures and labels, E included."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    label = (F.coalesce("good", F.lit(0)) + 2 * F.coalesce("bad", F.lit(0))).alias("label")
    # copies with one id count in one row from here on, so that no id gathers rows in the join
    rows = masks(docs, id_col, text_col, part_col).groupBy("doc_id", "part", "mask", "high", "low").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    rows = rows.select("doc_id", "part", "mask", "high", "low", "n", label)
    copies = rows.groupBy("high", "low", "part", "mask", "label", F.col("doc_id").isNull().alias("nameless")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    first = F.min("least").over(Window.partitionBy("high", "low"))
    fresh = F.when(F.col("nameless"), F.col("n")).when(F.col("least") == first, F.col("n_least")).otherwise(0)
    split = copies.withColumn("fresh", fresh).select(
        "part", "label", F.explode(F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))).alias("x"))
    return split.select("part", "x.mask", "label", "x.n").where("n > 0")


def partial_arrays(counts: DataFrame) -> DataFrame:
    """``part, cells``: the arrays that the tasks made of ``failure_counts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, orders = first_failures(), np.arange(len(ORDERS)) * (STEPS + 1)
        sums: dict[str, np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["part", "cells"])
            sums.clear()
            return out

        for batch in batches:
            names, masks_, label, n = batch.column(0).to_pylist(), *(batch.column(i).to_numpy() for i in (1, 2, 3))
            kinds: dict[str, int] = {}
            part = np.array([kinds.setdefault(x, len(kinds)) for x in names], np.int64)
            for name, k in kinds.items():
                mine = part == k
                mask, weight = masks_[mine], n[mine]
                cells = (orders + table[mask]) * LABELS + label[mine][:, None]
                # whole numbers below 2**53 are exact as weights
                got = np.bincount(cells.ravel(), np.repeat(weight, len(ORDERS)), _REMOVED)
                bits = (mask[:, None] >> np.arange(STEPS)) & 1
                lone = bits * (bits.sum(axis=1) == 1)[:, None]
                whole = np.concatenate([got, weight @ bits, weight @ lone, [weight.sum()]]).astype(np.int64)
                sums[name] = sums[name] + whole if name in sums else whole
                if len(sums) > _PARTS:
                    yield handed()
        if sums:
            yield handed()

    return counts.select("part", "mask", "label", "n").mapInArrow(count, "part string, cells array<long>")


def _report(part: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its sums, of which there are at most ``_CELLS``."""
    sums = np.zeros(_CELLS, np.int64)
    sums[part["cell"].to_numpy()] = part["n"].to_numpy()
    by_label = sums[:_REMOVED].reshape(len(ORDERS), STEPS + 1, LABELS)[:, :STEPS]
    fails, lone, total = sums[_REMOVED : _REMOVED + STEPS], sums[_REMOVED + STEPS : _REMOVED + 2 * STEPS], sums[-1]
    which = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    removed = by_label.sum(axis=2)
    shapley = np.bincount(which.ravel(), removed.ravel(), STEPS).astype(np.int64)
    columns = {
        "kept": total - removed.cumsum(axis=1), "removed": removed, "redundant": fails[which] - removed, "unique_fails": lone[which],
        "good_lost": by_label[..., [1, 3]].sum(axis=2), "toxic_lost": by_label[..., [2, 3]].sum(axis=2), "shapley": shapley[which],
    }
    keys = {"part": part["part"].iloc[0], "filter_order": np.repeat(ORDERS, STEPS), "step": np.tile(np.arange(1, STEPS + 1), len(ORDERS))}
    return pd.DataFrame(keys | {k: v.ravel() for k, v in columns.items()})


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step."""
    partial = partial_arrays(failure_counts(docs, labels, id_col, text_col, part_col))
    sums = partial.select("part", F.posexplode("cells").alias("cell", "n")).where("n > 0").groupBy("part", "cell").agg(F.sum("n").alias("n"))
    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return sums.groupBy("part").applyInPandas(_report, f"part string, filter_order string, step int, {counts}")
