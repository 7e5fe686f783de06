"""Taking a model's rewritten captions only where they keep to the original.

The model itself is the caller's: ``slots`` makes the request rows, ``fill`` puts any DataFrame of answers back."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.text import bare, has_caption, parse_answer, strip, thin_marks

SIMILAR = 0.70  # fixed value


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, with its treatment of popular characters in long texts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def guard(original: Column, got: Column) -> Column:
    """The accepted text: the original for an empty answer, other numbers, or an answer too unlike it; marks that do not
    pair, mark single words, or mark words that the original lacks are taken off."""
    first, answer = strip(F.coalesce(original, F.lit(""))), strip(F.coalesce(got, F.lit("")))
    answer = F.when(F.regexp_count(answer, F.lit(r"\*\*")) % 2 == 1, F.replace(answer, F.lit("**"), F.lit(""))).otherwise(answer)
    answer = thin_marks(answer)
    flat, plain = bare(first), bare(answer)
    numbers = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))
    invented = F.exists(F.regexp_extract_all(answer, F.lit(r"(?s)\*\*(.+?)\*\*"), F.lit(1)), lambda m: ~F.contains(flat, bare(m)))
    unmarked = F.when(invented, F.regexp_replace(answer, r"(?s)\*\*(.+?)\*\*", "$1")).otherwise(answer)
    # the costly comparison comes last, so it only runs where the cheap rules leave a choice
    far = F.when((answer != "") & (first != "") & (numbers(plain) == numbers(flat)), likeness(flat, plain) < SIMILAR)
    return F.when(answer == "", F.coalesce(original, F.lit(""))).when(first == "", answer).when(numbers(plain) != numbers(flat), first).when(far, first).otherwise(unmarked)


def slots(units: DataFrame) -> DataFrame:
    """Request rows ``code, pos, slot, kind``: units with a crop (``image``) or a caption (``text``), numbered from 1."""
    kind = F.when(F.coalesce(F.col("caption_crop") != "", F.lit(False)), "image").when(has_caption(F.col("caption")), "text")
    ordered = units.select("code", "pos", kind.alias("kind")).where("kind is not null").groupBy("code").agg(F.array_sort(F.collect_list(F.struct("pos", "kind"))).alias("s"))
    return ordered.select("code", F.posexplode("s").alias("i", "s")).select("code", "s.pos", (F.col("i") + 1).alias("slot"), "s.kind")


def fill(requests: DataFrame, units: DataFrame, answers: DataFrame) -> DataFrame:
    """``code, pos, caption, kept``: answers (code, answer) parsed and guarded, slot by slot; a short answer leaves the
    rest alone.  ``kept`` marks slots where the original stood against a different answer."""
    parsed = answers.select("code", F.posexplode(parse_answer(F.col("answer"))).alias("i", "got")).select("code", (F.col("i") + 1).alias("slot"), "got")
    joined = requests.join(parsed, ["code", "slot"], "left").join(units.select("code", "pos", F.coalesce("caption", F.lit("")).alias("original")), ["code", "pos"])
    taken = F.when(F.col("got").isNull(), F.col("original")).otherwise(guard(F.col("original"), F.col("got")))
    kept = (F.col("original") != "") & (taken == F.col("original")) & (bare(F.coalesce("got", F.col("original"))) != bare(F.col("original")))
    return joined.select("code", "pos", taken.alias("caption"), kept.alias("kept"))


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two answerers' captions (code, slot, caption, seconds) next to each other."""
    named = lambda d, s: d.select("code", "slot", F.col("caption").alias(f"caption_{s}"), F.col("seconds").alias(f"seconds_{s}"))
    return named(left, "a").join(named(right, "b"), ["code", "slot"], "full_outer")
