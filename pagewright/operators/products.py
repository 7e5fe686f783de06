"""Units of products: adverts, groups, pairs, merged corrections, nearest scraps and page scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import has_caption, typed_specs
from pagewright.operators.match import tag_unit

PAGE_WIDTH = 800  # fixed value


def leading_ads(pieces: DataFrame, key: str, pos: str, captioned: Column) -> DataFrame:
    """``is_ad``: pieces without a caption before the first captioned piece of their product."""
    first = pieces.groupBy(key).agg(F.min(F.when(captioned, F.col(pos))).alias("_first"))
    return pieces.join(first, key).withColumn("is_ad", F.col("_first").isNull() | (F.col(pos) < F.col("_first"))).drop("_first")


def views(units: DataFrame) -> DataFrame:
    """Per product: number of units, captions, tagged, body (untagged) and feature (untagged with a caption) units."""
    tagged, said = F.coalesce(F.col("option_tag") != "", F.lit(False)), has_caption(F.col("caption"))
    return units.groupBy("code").agg(
        F.count("*").alias("n_units"), F.count_if(said).alias("n_captioned"), F.count_if(tagged).alias("n_tagged"),
        F.count_if(~tagged).alias("n_body"), F.count_if(~tagged & said).alias("n_features"),
    )


def option_groups(units: DataFrame, key: str, pos: str, tag: str) -> DataFrame:
    """Tagged units by option, groups in the order they first appear: ``group_no, first_pos, n_units``."""
    groups = units.where(F.coalesce(F.col(tag), F.lit("")) != "").groupBy(key, tag).agg(F.min(pos).alias("first_pos"), F.count("*").alias("n_units"))
    return groups.withColumn("group_no", F.row_number().over(Window.partitionBy(key).orderBy("first_pos")) - 1)


def pair_vote(units: DataFrame, key: str, captioned: Column) -> DataFrame:
    """``split``: a page is taken apart unless fewer than half of its units have captions."""
    return units.groupBy(key).agg(F.count("*").alias("n_units"), F.count_if(captioned).alias("n_captioned")).withColumn("split", F.col("n_captioned") * 2 >= F.col("n_units"))


def merge_overrides(units: DataFrame, overrides: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Corrections by position.  A correction that is there counts even if it is empty; ``overrides`` has ``keys`` once."""
    own = overrides.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_there"))
    out = units.join(own, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_there") & F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)))
    return out.drop("_there", *(f"_new_{c}" for c in columns))


def corrected(units: DataFrame, typed: DataFrame, options: DataFrame) -> DataFrame:
    """``units (code, pos, caption, option_tag, ...)`` after the corrections ``typed (code, pos, caption, option_tag)``,
    each place once, null for what wasn't typed.  Captions of corrected products are matched with the sheet again, unless
    a tag was typed for the product; ``options (code, options)`` is null where the sheet is unknown."""
    sent = typed.groupBy("code").agg(F.max(F.coalesce(F.col("option_tag") != "", F.lit(False))).alias("_sent"))
    rows = merge_overrides(units, typed, ["code", "pos"], ["caption", "option_tag"]).join(sent, "code", "left")
    rows = rows.join(options.select("code", F.col("options").alias("_options")), "code", "left").withColumn("_new", tag_unit(F.col("caption"), F.col("_options")))
    again = F.coalesce(~F.col("_sent"), F.lit(False)) & (F.col("_new.option_tag") != "")
    return rows.withColumns({c: F.when(again, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("caption", "option_tag")}).select(units.columns)


def corrected_specs(typed: Column, guessed: Column) -> Column:
    """Measures that were typed, if any can be read, else the guessed ones."""
    read = typed_specs(F.coalesce(typed, F.lit("")))
    return F.when(F.size(read) > 0, read).otherwise(guessed)


def bounding_box(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def attach_scraps(scraps: DataFrame, pictures: DataFrame, key: str) -> DataFrame:
    """The picture each scrap belongs to: one in its row (overlapping in y), at the least distance, the first on a tie.
    Both have ``key, pos, x0, y0, x1, y1`` (inclusive); scraps without a picture in their row are left out."""
    s, p = scraps.alias("s"), pictures.alias("p")
    near = s.join(p, (F.col(f"s.{key}") == F.col(f"p.{key}")) & (F.col("s.y0") <= F.col("p.y1")) & (F.col("p.y0") <= F.col("s.y1")))
    gap = lambda a: F.greatest(F.lit(0), F.col(f"p.{a}0") - F.col(f"s.{a}1"), F.col(f"s.{a}0") - F.col(f"p.{a}1"))
    best = F.min_by("p.pos", F.struct(gap("x") + gap("y"), F.col("p.pos")))
    return near.groupBy(F.col(f"s.{key}").alias(key), F.col("s.pos").alias("scrap_pos")).agg(best.alias("picture_pos"))


def page_scale(widths: DataFrame, key: str, width: str) -> DataFrame:
    """``style_width``: widths scaled so that the page's widest is 800; null for the widest and for width 0."""
    widest = widths.groupBy(key).agg(F.max(width).alias("_widest"))
    scaled = F.bround(F.col(width) * (F.lit(PAGE_WIDTH) / F.col("_widest"))).cast("long")
    return widths.join(widest, key).withColumn("style_width", F.when((F.col(width) > 0) & (F.col(width) < F.col("_widest")), scaled)).drop("_widest")


def pick_codes(typed: Column) -> Column:
    """The product numbers (four digits or more) in a typed text, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(typed, F.lit("")), F.lit(r"(\d{4,})")))


def valid_code(code: Column) -> Column:
    return F.coalesce(code.rlike(r"^[A-Za-z0-9_-]{1,40}$"), F.lit(False))
