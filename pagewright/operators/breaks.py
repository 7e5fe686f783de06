"""Natural breaks of gaps and the groups they make: a session window whose gap is found in the data itself.

Each step that follows the order of a key's rows can be taken in buckets of that order: rows meet within a bucket, and
one row for each bucket carries what the next one needs.  So a key that holds a large share of all rows is spread over as
many tasks as it has buckets.  A bucket must not decrease along the order; without one a key is one bucket.  Null keys and
null buckets are a key and a bucket of their own, the null bucket the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMOOTH = 2  # fixed value: added to both gaps before they are divided
SPAN = 1 << 16  # whole numbers in a bucket


def span_of(number: Column) -> Column:
    """A bucket of at most ``SPAN`` different whole numbers."""
    return F.floor(number / SPAN)


def _beside(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the facts of their key; nulls are equal."""
    other = facts.withColumnsRenamed({k: f"_of_{k}" for k in on})
    same = F.lit(True)
    for k in on:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(other, same, "left").drop(*(f"_of_{k}" for k in on))


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, bucket: Column | None = None, back: bool = True) -> DataFrame:
    """``out``: ``value`` of the key's row before (after, without ``back``), null where there is none."""
    step = F.lag if back else F.lead
    boxed = F.struct(F.col(value).alias("v"))
    if bucket is None:
        return rows.withColumn(out, step(boxed).over(Window.partitionBy(*keys).orderBy(*order))["v"])
    held = rows.withColumn("_bucket", bucket)
    at_end = (F.max_by if back else F.min_by)(boxed, F.struct(*order))
    ends = held.groupBy(*keys, "_bucket").agg(at_end.alias("_end"))
    carried = ends.select(*keys, "_bucket", step("_end").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    inside = held.withColumn("_near", step(boxed).over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return _beside(inside, carried, [*keys, "_bucket"]).withColumn(out, F.coalesce("_near", "_carried")["v"]).drop("_bucket", "_near", "_carried")


def running(rows: DataFrame, keys: list[str], order: list[str], amount: Column, out: str, bucket: Column | None = None) -> DataFrame:
    """``out``: the sum of ``amount`` over the key's rows so far, this one included."""
    held = rows.withColumns({"_amount": amount, "_bucket": bucket if bucket is not None else F.lit(0)})
    totals = held.groupBy(*keys, "_bucket").agg(F.sum("_amount").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = _beside(held.withColumn("_inside", F.sum("_amount").over(inside)), totals, [*keys, "_bucket"])
    return summed.withColumn(out, F.col("_before") + F.col("_inside")).drop("_amount", "_bucket", "_before", "_inside")


def natural_breaks(gaps: DataFrame, keys: list[str], gap: str = "gap", min_ratio: float = 2.0, bucket: Column | None = None) -> DataFrame:
    """``keys, threshold, ratio``: the widest jump between neighbouring distinct gaps.  Ties go to the smaller gap;
    below ``min_ratio`` the threshold is null; a single distinct gap has ratio 1.  ``bucket`` is of the gap's values."""
    distinct = gaps.where(F.col(gap).isNotNull()).select(*keys, gap).distinct()
    pairs = previous(distinct, keys, [gap], gap, "_next", bucket, back=False)
    ratio = (F.col("_next") + SMOOTH) / (F.col(gap) + SMOOTH)
    best = pairs.withColumn("_ratio", ratio).groupBy(*keys).agg(F.max_by(gap, F.when(F.col("_ratio").isNotNull(), F.struct(F.col("_ratio"), -F.col(gap)))).alias("_lo"), F.max("_ratio").alias("_best"))
    best = best.withColumn("ratio", F.coalesce("_best", F.lit(1.0)))
    return best.select(*keys, F.when(F.col("ratio") >= min_ratio, F.when(F.col("_best").isNotNull(), F.col("_lo"))).alias("threshold"), "ratio")


def with_gaps(rows: DataFrame, keys: list[str], order: list[str], start: Column, end: Column | None = None, out: str = "gap", bucket: Column | None = None) -> DataFrame:
    """``out``: distance from the end of the previous row of the key (null on the first)."""
    held = rows.withColumn("_reach", end if end is not None else start)
    return previous(held, keys, order, "_reach", "_last", bucket).withColumn(out, start - F.col("_last")).drop("_reach", "_last")


def group_by_breaks(rows: DataFrame, keys: list[str], order: list[str], gap: str = "gap", min_ratio: float = 2.0, bucket: Column | None = None, gap_bucket: Column | None = None) -> DataFrame:
    """``rows`` with ``threshold, ratio, group_no`` (from 0).  ``bucket`` is of the order, ``gap_bucket`` of the gaps."""
    found = natural_breaks(rows, keys, gap, min_ratio, gap_bucket)
    flagged = _beside(rows, found, keys).withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    return running(flagged, keys, order, F.coalesce((F.col(gap) > F.col("threshold")).cast("long"), F.lit(0)), "group_no", bucket)


def value_runs(rows: DataFrame, keys: list[str], order: list[str], value: str, position: str, bucket: Column | None = None) -> DataFrame:
    """Maximal runs of rows with one value: ``keys, value, start, end`` of ``position``, inclusive.  Null is a value."""
    counted = running(rows, keys, order, F.lit(1), "_all", bucket)
    own = running(counted, [*keys, value], order, F.lit(1), "_own", bucket)
    marked = own.withColumn("_island", F.col("_all") - F.col("_own"))
    return marked.groupBy(*keys, value, "_island").agg(F.min(position).alias("start"), F.max(position).alias("end")).drop("_island")


def runs(rows: DataFrame, keys: list[str], order: list[str], flag: str, position: str, bucket: Column | None = None) -> DataFrame:
    """Maximal runs of rows with a true flag: ``keys, start, end`` of ``position``, inclusive."""
    return value_runs(rows, keys, order, flag, position, bucket).where(F.col(flag)).drop(flag)
