"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are grouped by their number of shingles into classes with upper bounds 8, 16, 32, ...  A document's shingles
are laid out in order and covered, for a class with bound u, by windows of 2u shingles at every u-th place, so any
passage of an item lies whole in one window, however long the document is.  Window and item are compared by ``HASHES``
minima: an item of the class with containment 0.8 has a Jaccard similarity of at least 0.19 with the window round it, so
the chance that none of 64 minima agrees is below 2e-6.  Items of up to four shingles need all of them, and one is
looked up exactly.  Candidates are verified by the exact share of the item's distinct shingles in the whole document.

Defined cases: an item or a document without words matches nothing; fewer than five words make one shingle; items with
equal text or repeated ids give a row each; null ids are carried; an empty table on either side gives an empty result;
columns that share a name with the results are not read.

Plan: documents are scanned once for each slice of the items of at most ``SLICE_BYTES`` bytes of text, which is sent to
the tasks; nothing is shuffled.  Several slices make several scans, so no bound is put on the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import mix64, shingles_of, texts

HASHES = 64
BASE = 8
TINY = 4
SLICE_BYTES = 16_000_000
_FACTORS = mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_LAST = np.iinfo(np.uint64).max


class ItemIndex:
    """Shingle sets of items and, for each size class, their minima under each hash function."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.sets = [np.unique(shingles_of(t)) for _, t in items]
        tiny = [k for k, s in enumerate(self.sets) if 0 < len(s) <= TINY]
        first = np.array([self.sets[k][0] for k in tiny], np.uint64)
        order = np.argsort(first, kind="stable")
        self.tiny_first, self.tiny = first[order], np.array(tiny, np.int64)[order]
        classes: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            if len(s) > TINY:
                classes.setdefault(max(0, int(np.ceil(np.log2(len(s) / BASE)))), []).append(k)
        self.classes = []
        for c, members in sorted(classes.items()):
            minima = np.stack([(self.sets[k][:, None] * _FACTORS).min(0) for k in members])
            order = np.argsort(minima, axis=0, kind="stable")
            low = np.zeros((HASHES, 1 << 16), bool)
            for i in range(HASHES):
                low[i, minima[:, i] & np.uint64(0xFFFF)] = True
            self.classes.append((c, np.array(members)[order.T], np.take_along_axis(minima, order, 0).T.copy(), low))

    def candidates(self, shingles: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document number, item number) of the documents of a batch."""
        sizes = [-(-len(s) // BASE) * BASE for s in shingles]
        ends = np.cumsum([0, *sizes])
        line = np.full(ends[-1] if len(ends) else 0, _LAST, np.uint64)
        for s, at in zip(shingles, ends, strict=False):
            line[at : at + len(s)] = s
        if not len(line):
            return set()
        found: set[tuple[int, int]] = set()
        if len(self.tiny):
            self._hits(line, np.arange(len(line)), 1, self.tiny_first, self.tiny, ends, found)
        if self.classes:
            holes = line == _LAST
            columns = np.ascontiguousarray(line.reshape(-1, BASE).T)
            gaps = np.ascontiguousarray(holes.reshape(-1, BASE).T)
            for i in range(HASHES):
                hashed = columns * _FACTORS[i]
                hashed[gaps] = _LAST
                level, span = hashed.min(0), 1  # level[j]: least of blocks j .. j + span - 1
                for c, members, minima, low in self.classes:
                    while span < 2 << c:
                        level = np.minimum(level, np.append(level[span:], np.full(min(span, len(level)), _LAST, np.uint64))[: len(level)])
                        span *= 2
                    stride = 1 << c
                    window = level[::stride]
                    at = np.flatnonzero(low[i][(window & np.uint64(0xFFFF)).astype(np.int64)])
                    if len(at):
                        self._hits(window[at], at * (stride * BASE), span * BASE, minima[i], members[i], ends, found)
        return found

    @staticmethod
    def _hits(values, places, width, keys, members, ends, found) -> None:
        lo, hi = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
        for k in np.flatnonzero(hi > lo):
            first = int(np.searchsorted(ends, places[k], "right")) - 1
            last = int(np.searchsorted(ends, places[k] + width - 1, "right")) - 1
            for doc in range(first, min(last, len(ends) - 2) + 1):
                found.update((doc, int(m)) for m in members[lo[k] : hi[k]])


def _slices(items: DataFrame, item_col: str, item_text_col: str) -> Iterator[ItemIndex]:
    """Indexes of the items, ``SLICE_BYTES`` of text each."""
    wanted = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    for k in range(slices):
        part = wanted if slices == 1 else wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        yield ItemIndex([(r.item, r.text) for r in part.collect()])


def _verified(index: ItemIndex, many: list[str | None], share: float) -> list[tuple[int, int, int, int]]:
    """(document, item, shared, size) of the items that stand in the texts, by exact containment."""
    shingles, out = [shingles_of(t) for t in many], []
    for doc, item in sorted(index.candidates(shingles)):
        need = index.sets[item]
        n = int(np.isin(need, shingles[doc]).sum())
        if n >= share * len(need) - 1e-9:
            out.append((doc, index.ids[item], n, len(need)))
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = 0.8) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of every document that holds at least ``share`` of an item's
    distinct shingles."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` long, n_shared long, n_item long, containment double"
    out = []
    for index in _slices(items, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    found = _verified(sent.value, texts(batch.column(1).slice(start, 500)), share)
                    columns = list(zip(*((item, n, size, n / size) for _, item, n, size in found), strict=True)) or [[]] * 4
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    ids = batch.column(0).slice(start, 500).take(pa.array([x[0] for x in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[id_col, item_col, "n_shared", "n_item", "containment"])

        out.append(docs.select(id_col, text_col).mapInArrow(run, schema))
    return reduce(DataFrame.union, out)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item.  Each is judged where it is read and moves nowhere; slices of the items follow
    each other in one scan."""
    at = docs.columns.index(text_col)
    for index in _slices(items, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    part = batch.slice(start, 500)
                    held = {x[0] for x in _verified(sent.value, texts(part.column(at)), share)}
                    yield part.filter(pa.array([i not in held for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
