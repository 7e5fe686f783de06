"""The gate and the tag match over streams of new products, in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.gate import pre_gate
from pagewright.operators.match import tag_unit


def hold_counts(products: DataFrame, time_col: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Reasons of the pre-gate per window of arrival; products (n_images, n_captions, n_options) later than ``late`` are
    left out, which bounds the state."""
    judged = products.withWatermark(time_col, late).withColumn("reason", F.explode(pre_gate(F.col("n_images"), F.col("n_captions"), F.col("n_options"))["reasons"]))
    return judged.groupBy(F.window(time_col, window).alias("w"), "reason").agg(F.count("*").alias("n")).select("w.start", "w.end", "reason", "n")


def tagged_units(units: DataFrame, options: DataFrame) -> DataFrame:
    """A stream of units (code, pos, caption) against the sheet's options (code, options); a code without a row there has
    unknown options."""
    return units.join(options, "code", "left").withColumn("u", tag_unit(F.col("caption"), F.col("options"))).select("code", "pos", "u.option_tag", "u.caption")


def sessions(events: DataFrame, key: str, time_col: str, gap: Column | str, late: str = "1 hour") -> DataFrame:
    """Sessions by a gap that may differ by row, such as a threshold found by ``natural_breaks`` and joined on."""
    return events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, "s.start", "s.end", "n")
