"""Quotation linking of conversations.

Every message is parsed into its own text and its quoted passages with their levels (a ``>`` for each level, also
``> >``; a line like ``On ... wrote:`` right before a quotation belongs to it).  Passages are normalised (ASCII lower
case, words only, one space) and hashed, as whole blocks, paragraphs and lines, and joined to the latest earlier message
of the conversation whose own text has the same passage.  A message answers the message that most of its level-1
quotation comes from (by characters; the later one on a tie).  Replies give each message a root and a depth, and
``reply_order``, the array of root, depth and turn, sorts a conversation so that an answer always follows what it answers.
Whole messages, their paragraphs and their lines are matched; a quoted part of a line links to nothing.

Defined cases: a null or empty text has no passages; a message without a linked quotation is a root; rows with a null
conversation or turn link with nothing and are kept; texts of any length are read whole; several rows with one conversation and turn are each kept and share
their links; a passage that many messages hold meets only its latest earlier holder; an empty table gives an empty
result; columns that share a name with the results are not read.

Plan: holders and quotations are matched by one window over (conversation, passage), not by a join of all pairs; roots
come from pointer doubling, whose rounds are the logarithm of the longest chain, and stop at once without quotations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed, texts

_PREFIX = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"(?i)\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$|^-+\s*original message\s*-+$")


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The message without its quotations, and the quoted blocks as (level, text) in order."""
    own: list[str] = []
    blocks: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _PREFIX.match(line)
        level = m[1].count(">") if m else 0
        if level:
            body = line[m.end() :]
            if last == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and _ATTRIBUTION.search(own[-1].strip()):
                    own.pop()
            if last == level and blocks:
                blocks[-1][1].append(body)
            else:
                if blocks and level > last > 0 and blocks[-1][1] and _ATTRIBUTION.search(blocks[-1][1][-1].strip()):
                    blocks[-1][1].pop()
                blocks.append((level, [body]))
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip(), [(level, "\n".join(body)) for level, body in blocks if any(x.strip() for x in body)]


def passages(text: str) -> dict[int, int]:
    """Hash -> characters of the whole text, its paragraphs and its lines, normalised."""
    out = {}
    for part in (text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")):
        norm = b" ".join(part.encode("utf-8", "replace").lower().split())
        if norm:
            value = xxhash.xxh3_64_intdigest(norm)
            out[value - (1 << 64) if value >= 1 << 63 else value] = len(norm)
    return out


def _passage_rows(messages: DataFrame) -> DataFrame:
    """``conv, turn, level, passage, size``; level 0 is a message's own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, quoted = parse(text)
                rows += [(conv, turn, level, key, size) for level, body in [(0, own), *quoted] for key, size in passages(body).items()]
            kinds = (batch.column(0).type, batch.column(1).type, pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv", "turn", "level", "passage", "size"])

    kinds = dict(messages.dtypes)
    return messages.where("conv is not null and turn is not null").mapInArrow(run, f"conv {kinds['conv']}, turn {kinds['turn']}, level int, passage long, size long")


def links(messages: DataFrame) -> DataFrame:
    """``conv, turn, level, source_turn, matched`` of messages (conv, turn, text): where each level mostly comes from."""
    rows = _passage_rows(messages.select("conv", "turn", "text"))
    earlier = Window.partitionBy("conv", "passage").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("source_turn", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(earlier)).where("level > 0 and source_turn is not null")
    matched = met.groupBy("conv", "turn", "level", "source_turn").agg(F.sum("size").alias("matched"))
    return matched.groupBy("conv", "turn", "level").agg(F.max_by("source_turn", F.struct("matched", "source_turn")).alias("source_turn"), F.max("matched").alias("matched"))


def roots(parents: DataFrame) -> DataFrame:
    """``conv, turn, root_turn, depth`` of the answers in ``parents (conv, turn, parent_turn)``, by pointer doubling."""
    state = checkpointed(parents.select("conv", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = state.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        moved = checkpointed(state.join(above, ["conv", "up"], "left").select("conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("on")))
        state = moved.drop("on")
        if moved.where("on").isEmpty():
            return state.withColumnRenamed("up", "root_turn")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """Per row: conversation, turn, role, ``clean_text``, ``n_quotes``, ``parent_turn``, ``quoted`` (level, source_turn),
    ``root_turn``, ``depth`` and ``reply_order``."""
    base = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    found = checkpointed(links(base))
    parents = found.where("level = 1").select("conv", "turn", F.col("source_turn").alias("parent_turn"))
    placed = parents.join(roots(parents), ["conv", "turn"])
    quoted = found.groupBy("conv", "turn").agg(F.array_sort(F.collect_list(F.struct("level", "source_turn"))).alias("quoted"))
    linked = quoted.join(placed, ["conv", "turn"], "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [parse(t) for t in texts(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([own for own, _ in done], pa.string()), pa.array([len(q) for _, q in done], pa.int64())], names=["conv", "turn", "role", "clean_text", "n_quotes"])

    kind = dict(base.dtypes)["conv"]
    out = base.mapInArrow(clean, f"conv {kind}, turn long, role string, clean_text string, n_quotes long").join(linked, ["conv", "turn"], "left")
    root, depth = F.coalesce("root_turn", "turn"), F.coalesce("depth", F.lit(0).cast("long"))
    order = F.array(root, depth, F.col("turn"))
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "clean_text", "n_quotes", "parent_turn", "quoted", root.alias("root_turn"), depth.alias("depth"), order.alias("reply_order"))
