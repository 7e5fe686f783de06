"""Small helpers that several text operators share: words, shingle hashes and columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.lineage import checkpointed

__all__ = ["IdFilter", "checkpointed", "hash_words", "mix64", "shingles_of", "small_batches", "texts", "words_of"]

MASK = (1 << 64) - 1
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64
)
_CACHE_WORDS = 100_000  # about 20 MB
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


class _WordHashes(dict):
    """Word -> 64-bit hash.  Emptied when full, so a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_word_hashes = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8; bytes methods only know ASCII."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles_of(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of the word shingles in text order; a shorter text is one shingle, an empty one has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = hash_words(words)
    span = min(width, len(words))
    n = len(words) - span + 1
    out = np.full(n, (span * 0x2545F4914F6CDD1D) & MASK, np.uint64)
    for j in range(span):
        out += hashes[j : j + n] * (_MULTIPLIERS[j % 5] + np.uint64(2 * (j // 5)))
    return mix64(out)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in Arrow batches of about ``BATCH_BYTES``.  Spark's own limit is 10,000
    rows, however long they are, which the executor and its workers each hold.  A limit that the session has stays."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def texts(column) -> list[str | None]:
    """An Arrow string column as Python strings."""
    return column.to_pylist()


class IdFilter:
    """A Bloom filter of ids of one size, 4 MB, whatever their number: a row that it passes over surely isn't meant, so
    only rows that it lets through have to move.  Half a million ids let through one other id in 90,000, four million one in
    50, and the share grows smoothly from there; nothing depends on it but what is moved."""

    CHUNKS, BITS, HASHES = 64, 1 << 19, 4

    def __init__(self, chunks: dict[int, bytes]):
        self.bits = np.zeros((self.CHUNKS, self.BITS // 8), np.uint8)
        for c, data in chunks.items():
            self.bits[c] = np.frombuffer(data, np.uint8)

    @classmethod
    def _places(cls, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk of each id, and its bits there."""
        mixed = mix64(ids.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
        chunk = (mixed >> np.uint64(58)).astype(np.int64)
        bits = [(mix64(mixed + np.uint64(k + 1)) & np.uint64(cls.BITS - 1)).astype(np.int64) for k in range(cls.HASHES)]
        return chunk, np.stack(bits, 1)

    @classmethod
    def of(cls, ids: DataFrame) -> IdFilter:
        """The filter of the one long column of ``ids``; each task marks its ids, and a task for each part of the bits joins
        the marks."""

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chunk, bits = cls._places(batch.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(chunk, cls.HASHES)), pa.array(bits.ravel())], names=["chunk", "bit"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, np.ndarray] = {}
            for batch in batches:
                chunk, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for c in np.unique(chunk).tolist():
                    at = bit[chunk == c]
                    np.bitwise_or.at(own.setdefault(c, np.zeros(cls.BITS // 8, np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([x.tobytes() for x in own.values()], pa.binary())], names=["chunk", "data"])

        name = ids.columns[0]
        marks = ids.where(F.col(name).isNotNull()).select(name).mapInArrow(mark, "chunk long, bit long")
        found = marks.repartition(cls.CHUNKS, "chunk").mapInArrow(join, "chunk long, data binary").collect()  # 4 MB at most
        return cls({r.chunk: bytes(r.data) for r in found})

    def may_hold(self, ids: pa.Array) -> np.ndarray:
        """Whether each id may be one of the filter's; a null isn't."""
        chunk, bits = self._places(ids.fill_null(0).to_numpy(zero_copy_only=False))
        hit = (self.bits[chunk[:, None], bits >> 3] >> (bits & 7).astype(np.uint8)) & 1
        return hit.all(axis=1) & ~np.array(ids.is_null())


def without_ids(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``rejected (id_col)``.  A filter of the rejected ids is tested in the scan;
    only rows that it lets through, the rejected ones and few others, are moved to be looked up."""
    ids = rejected.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct()
    sent = docs.sparkSession.sparkContext.broadcast(IdFilter.of(ids))
    at = docs.columns.index(id_col)

    def part(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(sent.value.may_hold(batch.column(at).cast(pa.int64())) == wanted))

        return docs.mapInArrow(run, docs.schema)

    looked_up = part(True)
    kept = looked_up.join(ids, looked_up[id_col].cast("long") == ids["_id"], "left_anti")
    return part(False).unionByName(kept)
