"""Quality rules with cross-document line frequency.

Lines are normalised (ASCII lower case, white space to one space) and hashed with their host.  For each host the
distinct documents that hold a line are counted, where documents with the same text count once, so exact copies do not
turn a clean document into boilerplate.  A line is above the limit if at least ``min_docs`` documents and more than
``share`` of the host's documents hold it; a share of 0 leaves the absolute limit alone, which doesn't rise with the
host.  With ``all_docs``, a line that at least so many distinct documents of all hosts together hold is above the limit
on every host.  ``op9_line_rules`` and the pipeline use ``LIMITS``: absolute limits, on a host and over all hosts.
Such lines are removed, and a document is rejected if it fails the base rules, has fewer than ``min_words`` words left or
lost more than half of its words.

A group of near copies would make each of its lines frequent and vanish whole.  With ``group_percent``, documents of which
lines above the limits hold at least ``GROUP_SHARE`` of the words are therefore grouped by similarity (shingles of five
words, at least that per cent of the union), and the texts of a group count once for a line; then the limits are asked
again.  Documents less covered are in no group: they count by text and stay in any case.

Defined cases: a null text counts as empty and fails; a null host is the host ``''``; rows with one id are separate
rows; texts of any length are read whole; an empty table gives an empty result; other columns pass through untouched, but
those that share a name with the results are replaced by them.

Plan: one pass emits a row per document and distinct line; the distinct count runs in two steps (first on host, line
and text, then on host and line with map-side sums), so a line that every document holds stays one row per task.  The count over all hosts runs
in the same two steps, on rows of one host more.  Votes of groups are counted on the covered documents
alone, as what they take from the first count (texts less groups, for each line), again in steps with map-side sums.  The
lines above the limits are sent to the tasks while they are at most ``broadcast_lines``; beyond that they are joined by
key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.lineage import Scratch
from pagewright.llm.common import checkpointed, texts
from pagewright.llm.near_dup import near_duplicates

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
LINE_DOCS = 8  # distinct documents that may not all hold a line, on one host or on all hosts together
GROUP_PERCENT = 80  # of the union of two documents' shingles of five words: near copies count once
GROUP_SHARE = 0.25  # of a document's words in lines above the limits, from which it is looked at for near copies
LIMITS = {"min_docs": LINE_DOCS, "share": 0.0, "all_docs": LINE_DOCS, "group_percent": GROUP_PERCENT}
ALL_SEED = 1
ALL_HOSTS = 0  # the host key of the count over all hosts
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_removed_lines long, n_removed_words long"


RESULTS = [*(x.split()[0] for x in STATS.split(", ")), "base_failed", "kept"]


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _key(data: bytes, seed: int = 0) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data, seed))


def _lines(host: str | None, text: str) -> list[tuple[int, int]]:
    """(key, words) of each line; key 0 and no words for a blank line."""
    salt = (host or "").encode("utf-8", "replace") + b"\0"
    out = []
    for line in text.encode("utf-8", "replace").lower().split(b"\n"):
        words = line.split()
        out.append((_signed(xxhash.xxh3_64_intdigest(salt + b" ".join(words))) if words else 0, len(words)))
    return out


def _shared_lines(text: str) -> list[int]:
    """Key of each line on all hosts together, 0 for a blank line; the seed keeps it apart from the hosts' keys."""
    return [_key(b" ".join(words), ALL_SEED) if (words := line.split()) else 0 for line in text.encode("utf-8", "replace").lower().split(b"\n")]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the list, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    numbers = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    codes = numbers[:n].copy()
    for j in range(1, width):  # exact: each step ranks pairs of numbers below the count of words
        codes = codes * len(ids) + numbers[j : j + n]
        if j < width - 1 and len(ids) ** 2 * n > 1 << 62 or len(ids) ** (j + 2) > 1 << 62:
            codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _base(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "replace").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
    )


def _held(docs: DataFrame, text_col: str, host_col: str, all_docs: int | None) -> DataFrame:
    """``host_key, line_key, text_key``: the lines of each row, and key 0 for its host."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            hosts, keys, owners = [], [], []
            for host, text in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
                own = _key((text or "").encode("utf-8", "replace"))
                found = {key for key, words in _lines(host, text or "") if words}
                found.add(0)
                home = _key((host or "").encode("utf-8", "replace"))
                hosts += [home] * len(found)
                owners += [own] * len(found)
                keys += found
                if all_docs is not None:
                    shared = set(_shared_lines(text or "")) - {0}
                    hosts += [ALL_HOSTS] * len(shared)
                    owners += [own] * len(shared)
                    keys += shared
            yield pa.record_batch([pa.array(hosts, pa.int64()), pa.array(keys, pa.int64()), pa.array(owners, pa.int64())], ["host_key", "line_key", "text_key"])

    rows = docs.select(F.col(host_col).alias("h"), F.col(text_col).alias("t")).mapInArrow(emit, "host_key long, line_key long, text_key long")
    return rows.groupBy("host_key", "line_key", "text_key").agg(F.lit(1).alias("one"))


def frequent_lines(
    docs: DataFrame, min_docs: int = 8, share: float = 0.05, text_col: str = "text", host_col: str = "source", all_docs: int | None = None
) -> DataFrame:
    """``line_key, n_docs`` of the lines above the limits, and the limits: ``n_docs`` is ``least`` or more, and over ``over``."""
    counted = _held(docs, text_col, host_col, all_docs).groupBy("host_key", "line_key").agg(F.sum("one").alias("n_docs"))
    # The lines that reach min_docs are few; host totals are the rows of key 0.
    least = F.when(F.col("host_key") == ALL_HOSTS, F.lit(all_docs)).otherwise(F.lit(min_docs))
    held = checkpointed(counted.withColumn("least", least).where((F.col("line_key") == 0) | (F.col("n_docs") >= F.col("least"))))
    totals = held.where("line_key = 0").select("host_key", (F.lit(float(share)) * F.col("n_docs")).alias("over"))
    above = held.where("line_key <> 0").join(totals, "host_key").where("n_docs > over").select("line_key", "n_docs", "least", "over")
    return above if all_docs is None else above.union(held.where(F.col("host_key") == ALL_HOSTS).select("line_key", "n_docs", "least", F.lit(0.0)))


def _marked(docs: DataFrame, frequent: DataFrame, text_col: str, host_col: str, shared: bool, broadcast_lines: int):
    """``docs`` with a last column of the numbers of their frequent lines, and the frequent keys where they are sent
    instead (the column is null then)."""
    if frequent.count() <= broadcast_lines:
        keys = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in frequent.select("line_key").collect()))
        return docs.withColumn(_free("_removed", docs.columns), F.lit(None).cast("array<int>")), keys
    return _joined(docs, frequent, text_col, host_col, shared), None


def _frequent_in(lines: list[tuple[int, int]], text: str, removed: list[int] | None, sent, shared: bool) -> set[int]:
    """Numbers of the frequent lines of a text, from its own column or the keys sent."""
    if sent is None:
        return set(removed or ())
    out = {i for i, (key, words) in enumerate(lines) if words and key in sent.value}
    return out | {i for i, key in enumerate(_shared_lines(text)) if key and key in sent.value} if shared else out


def _grouped(
    docs: DataFrame, frequent: DataFrame, text_col: str, host_col: str, all_docs: int | None, broadcast_lines: int, percent: int
) -> DataFrame:
    """``frequent`` after the texts of a group of near copies have counted once."""
    scratch, shared = Scratch(docs.sparkSession), all_docs is not None
    slim = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    source, sent = _marked(slim, frequent, "text", "host", shared, broadcast_lines)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            ids, chosen = [], []
            for i, (host, text, removed) in enumerate(zip(*(texts(batch.column(k)) for k in range(3)), strict=True)):
                lines = _lines(host, text or "")
                inside = sum(lines[at][1] for at in _frequent_in(lines, text or "", removed, sent, shared))
                if inside and inside >= GROUP_SHARE * sum(words for _, words in lines):
                    ids.append(_key(text.encode("utf-8", "replace")))
                    chosen.append(i)
            part = batch.take(pa.array(chosen, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), part.column(0), part.column(1)], names=["text_key", "host", "text"])

    covered = scratch.keep(source.mapInArrow(pick, "text_key long, host string, text string"))
    if covered.isEmpty():
        scratch.drop(covered)
        return frequent
    judged = near_duplicates(covered, "text_key", "text", percent).select("text_key", F.col("component_id").alias("group")).distinct()
    judged = scratch.keep(judged)
    several = judged.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    voters = judged.join(several, "group", "left_semi")
    own = _held(covered, "text", "host", all_docs).where("line_key <> 0").join(voters, "text_key")
    spare = own.groupBy("line_key", "group").agg((F.sum("one") - 1).alias("spare")).groupBy("line_key").agg(F.sum("spare").alias("spare"))
    votes = F.col("n_docs") - F.coalesce("spare", F.lit(0))
    found = frequent.join(spare, "line_key", "left").withColumn("n_docs", votes).where("n_docs >= least and n_docs > over")
    found = checkpointed(found.select(*frequent.columns))
    scratch.drop(covered, judged)
    return found


def apply_line_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 8, share: float = 0.05,
    min_words: int = 10, keep_share: float = 0.5, broadcast_lines: int = 500_000, clean_col: str | None = "clean_text",
    all_docs: int | None = None, group_percent: int | None = None,
) -> DataFrame:
    """``docs`` with the rule counts, ``base_failed``, ``kept`` and, unless ``clean_col`` is None, the text without
    the removed lines."""
    docs = docs.drop(*(set(RESULTS) | {clean_col} if clean_col else set(RESULTS)) - {id_col, text_col, host_col})
    frequent, shared = checkpointed(frequent_lines(docs, min_docs, share, text_col, host_col, all_docs)), all_docs is not None
    if group_percent is not None:
        frequent = _grouped(docs, frequent, text_col, host_col, all_docs, broadcast_lines, group_percent)
    source, sent = _marked(docs, frequent, text_col, host_col, shared, broadcast_lines)
    names = docs.columns
    at_text, at_host, at_removed = names.index(text_col), names.index(host_col), len(names)  # the removed lines come last
    tail = STATS + (f", `{clean_col}` string" if clean_col else "")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            rows, cleaned = [], []
            gone = texts(batch.column(at_removed)) if sent is None else [None] * batch.num_rows
            for host, text, removed in zip(texts(batch.column(at_host)), texts(batch.column(at_text)), gone, strict=True):
                lines = _lines(host, text or "")
                out = _frequent_in(lines, text or "", removed, sent, shared)
                rows.append((*_base(text or ""), len(out), sum(lines[i][1] for i in out)))
                if clean_col:
                    cleaned.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in out) if out else text)
            arrays = [batch.column(i) for i in range(len(names))]
            arrays += [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(cleaned, pa.string())] if clean_col else []), names=names + [x.strip().split()[0].strip("`") for x in tail.split(",")])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    counted = source.mapInArrow(judge, f"{fields}, {tail}")
    failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    rest = F.col("n_words") - F.col("n_removed_words")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (rest >= min_words) & (rest >= F.lit(keep_share) * F.col("n_words")))


def _joined(docs: DataFrame, frequent: DataFrame, text_col: str, host_col: str, shared: bool = False) -> DataFrame:
    """``docs`` with the numbers of their frequent lines, by a join on the line's key instead of a sent table."""
    row = _free("_row", docs.columns)
    marked = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(texts(batch.column(k)) for k in range(3)), strict=True))
            out = [(row, i, key) for row, host, text in rows for i, (key, words) in enumerate(_lines(host, text or "")) if words]
            if shared:
                out += [(row, i, key) for row, _, text in rows for i, key in enumerate(_shared_lines(text or "")) if key]
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["row", "line", "line_key"])

    lines = marked.select(row, F.col(host_col).alias("h"), F.col(text_col).alias("t")).mapInArrow(emit, "row long, line int, line_key long")
    removed = _free("_removed", docs.columns)
    hits = lines.join(frequent.select("line_key"), "line_key").groupBy(F.col("row").alias(row)).agg(F.collect_set("line").alias(removed))
    return marked.join(hits, row, "left").select(*docs.columns, removed)
