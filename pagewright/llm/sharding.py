"""A uniform shuffle of documents into shards of exact sizes, by a hypergeometric communication matrix.

The law is ``rows``: the shards' row counts differ by one at most, which ones take a row more is drawn.  The table is read in
blocks of consecutive rows of a file.  How many rows of each block go to each shard is drawn exactly, as a uniform
permutation of the whole table would spread them: the rows of the matrix are multivariate hypergeometric draws from the room
that is left in the shards.  A block's rows are permuted and cut by its row of the matrix, the rows are exchanged, and each
shard is permuted again: its rows are scattered over chunks at random, the chunks' counts give their offsets, and a chunk is
sorted by random keys.  So each order of the whole table is equally likely, and equal texts are spread like any others.

Defined cases: a null text is empty, of size 8 and checksum 0; rows of one id, and rows without one, are separate rows, each
with its own slot; texts of any length are measured whole; fewer rows than shards leave shards empty; columns of the table
whose names clash with results aren't read; an empty table gives an empty result.

Plan: the matrix is a function of the seed and the blocks' counts, and a row's place one of its file, its number in that file
and the matrix, so a lost task makes the same rows again whatever the splits are.  Counts are read from the files'
row numbers alone.  The matrix has one row a block, and blocks are whole files up to ``BLOCK_ROWS``: 24 counts of 8 bytes for
a file, at most ``MAX_BLOCKS`` blocks (200 MB); a table of more files has to be compacted first and is an error.  The one
exchange moves rows by (shard, chunk), about ``chunk_rows`` of them at once however many rows a shard has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.lineage import Scratch

SHARDS = 24
OVERHEAD = 8  # bytes of a row besides its text
BLOCK_ROWS = 1 << 20
CHUNK_ROWS = 1 << 18
MAX_BLOCKS = 1 << 20
_EXACT = 10**9  # numpy's own draws end here
_TAILS = 12  # standard deviations on each side beyond which a draw has a probability below 1e-30


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn of good + bad, for any counts."""
    if good + bad < _EXACT:
        return int(rng.hypergeometric(good, bad, n))
    low, high, mean = max(0, n - bad), min(good, n), n * (good / (good + bad))
    reach = _TAILS * (mean * (bad / (good + bad)) + 1) ** 0.5 + 40
    k = np.arange(max(low, int(mean - reach)), min(high, int(mean + reach)) + 1, dtype=float)
    # logarithms of the shares of neighbours, summed from the left end and scaled by the largest
    steps = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    shares = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(shares, rng.random() * shares[-1], side="right")])


def shard_sizes(rng: np.random.Generator, rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart; which shards take a row more is drawn."""
    sizes = np.full(shards, rows // shards, np.int64)
    sizes[rng.permutation(shards)[: rows % shards]] += 1
    return sizes


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows of each block that go to each shard.  Rows sum to ``counts``, columns to sizes at most one apart."""
    rng = np.random.default_rng([seed, 0])
    room = shard_sizes(rng, sum(counts), shards)
    out = np.zeros((len(counts), shards), np.int64)
    for b, n in enumerate(counts):
        left, rest = n, int(room.sum())
        for s in range(shards):
            if not left:
                break
            own = int(room[s])
            rest -= own
            out[b, s] = take = left if not rest else _hypergeometric(rng, own, rest, left) if own else 0
            left -= take
        room -= out[b]
    return out


class _Blocks:
    """What a task knows of the blocks: their keys in order, and where each shard begins among a block's permuted rows."""

    def __init__(self, keys: list[tuple[int, int]], matrix: np.ndarray, chunks: np.ndarray, seed: int):
        self.index = {key: b for b, key in enumerate(keys)}
        self.ends, self.chunks, self.seed = np.cumsum(matrix, axis=1), chunks, seed
        self.at, self.drawn = -1, ()

    def places(self, block: tuple[int, int], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, chunk and random key of rows of one block."""
        b = self.index[block]
        if b != self.at:  # drawn whole for each block that a task meets: 24 bytes a row
            n, rng = int(self.ends[b, -1]), np.random.default_rng([self.seed, 1, b])
            shard = np.searchsorted(self.ends[b], rng.permutation(n), side="right")
            self.at, self.drawn = b, (shard, (rng.random(n) * self.chunks[shard]).astype(np.int64), rng.integers(0, 1 << 63, n))
        return tuple(x[rows] for x in self.drawn)


def _numbered(docs: DataFrame) -> DataFrame:
    """The table with the hash of each row's file, its number there and its block."""
    row = F.col("_metadata.row_index")
    return docs.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_row": row, "_block": F.floor(row / BLOCK_ROWS).cast("long")})


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = 13, chunk_rows: int = CHUNK_ROWS, with_text: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row of a table read from Parquet, and with
    ``with_text`` the text.  A table that is no plain scan is written to the shared folder first."""
    spark = docs.sparkSession
    if not _is_scan(docs):
        docs = Scratch(spark).keep(docs.select(id_col, text_col))
    numbered = _numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "_metadata"))
    counted = numbered.groupBy("_file", "_block").count().take(MAX_BLOCKS + 1)
    if len(counted) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} files or blocks of rows: compact the table first")
    found = sorted((r[0], r[1], r[2]) for r in counted)
    matrix = communication_matrix([n for *_, n in found], shards, seed)
    chunks = np.maximum(1, -(-matrix.sum(axis=0) // chunk_rows)) if found else np.ones(shards, np.int64)
    blocks = spark.sparkContext.broadcast(_Blocks([(f, b) for f, b, _ in found], matrix, chunks, seed))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, block, row = (batch.column(i).to_numpy() for i in range(3))
            # a batch holds few runs of one file and block
            cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
            parts = [blocks.value.places((int(file[a]), int(block[a])), row[a:z] - block[a] * BLOCK_ROWS) for a, z in zip([0, *cuts], [*cuts, len(row)], strict=True) if z > a]
            shard, chunk, key = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
            arrays = [batch.column(i) for i in range(batch.num_columns)] + [pa.array(shard.astype(np.int32)), pa.array(chunk), pa.array(key)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "shard", "chunk", "key"])

    text = F.coalesce(F.col("text"), F.lit(""))
    slim = numbered.select("_file", "_block", "_row", "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *["text"] * with_text)
    fields = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    places = "shard int, chunk long, key long"
    rows = slim.mapInArrow(scatter, f"{fields(slim)}, {places}")
    bare = numbered.select("_file", "_block", "_row")
    sizes = bare.mapInArrow(scatter, f"{fields(bare)}, {places}").groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    offsets = sizes.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("key", "_file", "_row")) - 1
    placed = rows.join(offsets, ["shard", "chunk"]).withColumn("slot", (F.col("offset") + within).cast("long"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *["text"] * with_text)


def _is_scan(docs: DataFrame) -> bool:
    """Whether the table is all rows of Parquet files, and no more than a choice of columns was made since."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.toString().strip().endswith("parquet")


def write_shards(docs: DataFrame, folder: str, **options) -> None:
    """The shards as Parquet below ``folder``, one directory each, with their texts in the order of the slots; files hold
    ascending ranges of slots."""
    placed = assign(docs, with_text=True, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
