"""Matching captions' tags to options, as expressions over a product's option array: no shuffle, no pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import split_tag, squash


def match_tag(tag: Column, options: Column) -> Column:
    """The option whose key equals the tag's (the last such), else the only one of which either key begins the other;
    '' if none or several do."""
    key = squash(tag)
    equal = F.filter(options, lambda o: squash(o) == key)
    keys = F.array_distinct(F.transform(options, squash))
    near = F.filter(keys, lambda k: k.startswith(key) | F.startswith(key, k))
    spelled = F.filter(options, lambda o: squash(o) == F.get(near, F.lit(0)))
    return F.when(F.size(equal) > 0, F.element_at(equal, F.size(equal))).when(F.size(near) == 1, F.element_at(spelled, F.size(spelled))).otherwise("")


def tag_unit(caption: Column, options: Column) -> Column:
    """struct(option_tag, caption).  No options (empty) leaves the caption; unknown options (null) trust its tag; known
    options need a match, and give their own spelling."""
    parts = split_tag(caption)
    found = F.when(options.isNull(), parts["tag"]).when(F.size(options) == 0, "").otherwise(F.when(parts["tag"] == "", "").otherwise(match_tag(parts["tag"], options)))
    return F.struct(found.alias("option_tag"), F.when(found != "", parts["rest"]).otherwise(caption).alias("caption"))


def orphan_options(options: Column, tags: Column) -> Column:
    """Options without a tagged unit, in the sheet's order, repeats kept."""
    return F.filter(options, lambda o: ~F.array_contains(tags, o))


def option_number(tag: Column, options: Column, numbers: Column, fallback: Column) -> Column:
    """The sheet's own number of an option, else its place (or the given one) counted from 1."""
    at = F.array_position(options, tag).cast("int")
    own = F.when(at > 0, F.get(numbers, at - 1))
    return F.when(F.coalesce(own, F.lit("")) != "", own).otherwise((F.when(at > 0, at - 1).otherwise(fallback) + 1).cast("string"))
