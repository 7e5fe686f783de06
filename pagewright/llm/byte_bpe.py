"""Byte-level BPE by a monoid tree: halves are encoded recursively and joined at their border.

``Ranks.join`` is the monoid's operation on token lists.  Two neighbours are stable if encoding the bytes of both gives
the two back.  A list whose neighbours are all stable is the encoding of its bytes, so a join only re-encodes a window
round the border and widens it until the pairs at its edges are stable.  Decoding joins byte strings up a tree.

Texts come in slices of ``SLICE_BYTES``: each distinct chunk between spaces is looked at once in a slice, and the short
pieces of those that are new are merged side by side, a merge of each in a step.

Defined cases: a null text is encoded as the empty text, with no ids; texts of any length are encoded whole; an empty
table gives an empty result; repeated rows give repeated results; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF_BYTES = 16  # merged directly, a choice of speed: the tree down to bytes gives the same ids in 2.3 x the time
NEVER = 1 << 40
SLICE_BYTES = 2 << 20  # with 8 MB a slice's lists, arrays and new chunks took 200 MB more
BLOCK = 4096  # strings that are merged side by side
_CACHE_BYTES = 1 << 20  # of chunks, about 100,000; with their ids 20 MB, and as much for the older ones; a slice's come on top
_CACHE_PAIRS = 200_000  # about 30 MB
_LOADED: dict[tuple[str, str], Ranks] = {}


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each part, one part after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Ranks:
    """The tables of a rank file, and what was encoded lately."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF_BYTES):
        self.leaf = leaf
        with open(path, "rb") as lines:
            self.id_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.id_of.values()) + 1)
        for token, number in self.id_of.items():
            self.bytes_of[number] = token
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.token_sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        # ids of neighbours that merge, as one sorted number, and what they become
        get = self.id_of.get
        pairs = {a << 32 | b: n for token, n in self.id_of.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None}
        self.pairs = np.array([-1, *sorted(pairs)])
        self.merges = np.array([0, *map(pairs.__getitem__, self.pairs[1:].tolist())])
        self.byte_ids = np.array([self.id_of[bytes([i])] for i in range(256)])
        self.byte_pairs = self._become(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.split = regex.compile(pattern).findall
        self.spaced = pattern == public_tokenizers.PATTERN
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of chunks
        self.stable: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges by rank, the leftmost first: a scan for short strings, a heap over links for long ones."""
        if len(data) > 40:
            return self._merged_long(data)
        get = self.id_of.get
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [get(parts[i] + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
        while costs and (best := min(costs)) != NEVER:
            i = costs.index(best)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return [self.id_of[p] for p in parts]

    def _become(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of ids merge into, NEVER if they don't."""
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys, "right") - 1
        return np.where(self.pairs[at] == keys, self.merges[at], NEVER)

    def merged_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of strings: ``merged`` of them all, the first of the lowest merges of each in a step."""
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        out = [b""] * len(pieces)
        for i in range(0, len(order), BLOCK):
            block = order[i : i + BLOCK]
            for k, packed in zip(block, self._merged_block([pieces[k] for k in block]), strict=True):
                out[k] = packed
        return out

    def _merged_block(self, pieces: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max()) + 1  # the last column stays empty
        there = np.arange(width) < sizes[:, None]
        data = np.zeros((len(pieces), width), np.int64)
        data[there] = np.frombuffer(b"".join(pieces), np.uint8)
        parts = np.where(there, self.byte_ids[data], -1)
        costs = np.where(there[:, 1:], self.byte_pairs[data[:, :-1] << 8 | data[:, 1:]], NEVER)
        done, rows = np.full((len(pieces), width), -1), np.arange(len(pieces))
        while True:
            own, at = np.arange(len(rows)), costs.argmin(1)
            best = costs[own, at]
            live = best != NEVER
            if not live.all():
                done[rows[~live], : parts.shape[1]] = parts[~live]
                rows, parts, costs, at, best, own = rows[live], parts[live], costs[live], at[live], best[live], own[: live.sum()]
            if not len(rows):
                break
            kept = np.arange(parts.shape[1] - 1) <= at[:, None]
            parts = np.where(kept, parts[:, :-1], parts[:, 1:])
            costs = np.where(kept[:, :-1], costs[:, :-1], costs[:, 1:])
            parts[own, at] = best
            right = parts[own, at + 1]
            costs[own, at] = np.where(right >= 0, self._become(best, right), NEVER)
            left = own[at > 0]
            costs[left, at[left] - 1] = self._become(parts[left, at[left] - 1], best[left])
        held = done >= 0
        packed, ends = done[held].astype("<u4").tobytes(), (4 * np.cumsum(held.sum(1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merged_long(self, data: bytes) -> list[int]:
        size = len(data)
        ends, before = list(range(1, size + 1)), list(range(-1, size))  # of the part that starts at i: its end, the start before
        heap = []

        def push(i: int) -> None:
            if i >= 0 and ends[i] < size:
                rank = self.id_of.get(data[i : ends[ends[i]]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ends[ends[i]]))

        for i in range(size - 1):
            push(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if middle in (0, size) or ends[middle] != end:
                continue
            ends[i], ends[middle] = end, 0
            if end < size:
                before[end] = i
            push(before[i])
            push(i)
        out, i = [], 0
        while i < size:
            out.append(self.id_of[data[i : ends[i]]])
            i = ends[i]
        return out

    def is_stable(self, a: int, b: int) -> bool:
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) >= _CACHE_PAIRS:
                self.stable.clear()
            known = self.stable[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.is_stable(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        step = 1
        while True:
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            left_ok = i == 0 or self.is_stable(left[i - 1], window[0])
            right_ok = j == len(right) or self.is_stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[:i] + window + right[j:]
            i = i if left_ok else max(0, i - step)
            j = j if right_ok else min(len(right), j + step)
            step *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        whole = self.id_of.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= self.leaf:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def packed(self, piece: str) -> bytes:
        ids = self.encode_bytes(piece.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _joined(self, split: list[list[str]]) -> list[bytes]:
        """Packed ids of lists of pieces; each distinct piece is encoded once, short ones side by side, long ones up the tree."""
        known = dict.fromkeys(piece for pieces in split for piece in pieces)
        short = []
        for piece in known:
            data = piece.encode("utf-8", "replace")
            if len(data) <= self.leaf and data not in self.id_of:
                short.append((piece, data))
            else:
                known[piece] = self.packed(piece)
        known.update(zip([p for p, _ in short], self.merged_many([d for _, d in short]), strict=True))
        return [known[pieces[0]] if len(pieces) == 1 else b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def _chunks(self, chunks: list[str], size: int) -> list[bytes]:
        """Packed ids of distinct chunks of ``size`` bytes in all, each with a space before it.

        In the public pattern only white space or the start of a match can be a space, so where neither neighbour of a
        space is white space a match starts at the space, and what stands between two such spaces is split by itself.
        Letters alone are one match.
        """
        now, older = self.chunks.get, self.older.get
        out = [now(chunk) or older(chunk) for chunk in chunks]
        new = [i for i, packed in enumerate(out) if packed is None]
        split = [[" " + chunk] if chunk.isalpha() else self.split(" " + chunk) for chunk in map(chunks.__getitem__, new)]
        for i, packed in zip(new, self._joined(split), strict=True):
            out[i] = packed
        if self.held > _CACHE_BYTES:  # what isn't asked for again goes at the next time
            self.chunks, self.older, self.held = {}, self.chunks, 0
        if size <= SLICE_BYTES:
            before = len(self.chunks)  # chunks that come over from the older ones count as well
            self.chunks.update(zip(chunks, out, strict=True))
            self.held += size * (len(self.chunks) - before) // max(1, len(chunks))
        return out

    def encode_many(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the whole texts of a string array, one text after the other, and how many each has.  Nulls are empty."""
        column = column.fill_null("")
        n = len(column)
        if not self.spaced:
            packs = self._joined(list(map(self.split, column.to_pylist())))
            return np.frombuffer(b"".join(packs), "<u4"), np.fromiter((len(p) // 4 for p in packs), np.int64, n)
        listed = pc.split_pattern(column, " ")
        starts = listed.offsets.to_numpy()[:-1]
        spaced = np.ones(len(listed.values), bool)
        spaced[starts] = False
        coded = listed.values.filter(pa.array(spaced)).dictionary_encode()
        chunks, heads = coded.dictionary, listed.values.take(pa.array(starts)).to_pylist()
        codes = np.empty(len(spaced), np.int64)
        codes[spaced] = coded.indices.to_numpy()
        codes[starts] = len(chunks) + np.arange(n)
        # a text with white space beside a space is split as a whole and stands in its head's place
        wide = pc.or_(pc.equal(chunks, ""), pc.not_equal(pc.utf8_trim_whitespace(chunks), chunks)).to_numpy(zero_copy_only=False)
        ends_wide = np.concatenate([wide, np.fromiter((h[-1:].isspace() for h in heads), bool, n)])
        whole = np.logical_or.reduceat(ends_wide[codes], starts) if n else np.zeros(0, bool)
        for i in np.flatnonzero(whole).tolist():
            heads[i] = column[i].as_py()
        known = chunks.filter(pa.array(~wide))
        packs = [b""] * len(chunks)
        for i, packed in zip(np.flatnonzero(~wide).tolist(), self._chunks(known.to_numpy(zero_copy_only=False).tolist(), known.nbytes), strict=True):
            packs[i] = packed
        packs += self._joined(list(map(self.split, heads)))
        sizes = np.fromiter(map(len, packs), np.int64, len(packs)) // 4
        own = sizes[codes]
        own[spaced & np.repeat(whole, np.diff(starts, append=len(codes)))] = 0
        first = np.cumsum(sizes) - sizes
        return np.frombuffer(b"".join(packs), "<u4")[_ragged(first[codes], own)], np.add.reduceat(own, starts) if n else own

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        return self.encode_many(pa.array([text], pa.string()))[0].tobytes()

    def decode(self, ids: list[int] | np.ndarray, leaf: int = 8192) -> bytes:
        ids = np.asarray(ids, np.int64)
        level = [self.token_bytes[_ragged(self.token_starts[part], self.token_sizes[part])].tobytes() for part in (ids[i : i + leaf] for i in range(0, len(ids), leaf))]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def ranks(path: str, pattern: str = public_tokenizers.PATTERN) -> Ranks:
    """The tables of a rank file, read once for each worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Ranks(path, pattern)
    return _LOADED[path, pattern]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``SLICE_BYTES`` of text; a longer text comes with the rest of a slice at most."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
    starts = np.flatnonzero(np.diff(ends // SLICE_BYTES, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if wanted, ``token_ids``."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path, pattern)
        for batch in (part for whole in batches for part in _slices(whole)):
            ids, counts = table.encode_many(batch.column(1))
            ends = np.cumsum(counts)
            rows = [ids[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            hashes, decoded = ([hashlib.sha256(data).hexdigest() for data in made] for made in (rows, map(table.decode, rows)))
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Per row: id and the decoded bytes (``decoded`` binary); a null list decodes to no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path, pattern)
        for batch in batches:
            done = [table.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, decoded binary")
