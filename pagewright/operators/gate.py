"""The quality gate as expressions: reasons stop a page (each once, in order), notes are only kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import SENTENCE_ENDS, strip

_NONE = "cast(array() as array<string>)"


def _list(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _note(code: str, *parts) -> Column:
    return F.concat(F.lit(f"{code}: "), *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def pre_gate(n_images: Column, n_captions: Column, n_options: Column) -> Column:
    """struct(reasons, notes) from the sheet alone, before any picture is read."""
    empty, crowded = n_images == 0, (n_options > n_images) & (n_images > 1)
    reasons = F.when(empty, F.array(F.lit("NO_BODY_IMAGE"))).otherwise(_list(F.when(crowded, F.lit("OPTION_UNMAPPABLE"))))
    silent = (n_images >= 6) & (n_captions == 0)
    notes = F.when(empty, F.array(F.lit("NO_BODY_IMAGE: no picture"))).otherwise(_list(
        F.when(silent, _note("NO_CAPTION_MULTI_IMG", n_images, " pictures, no caption")),
        F.when(crowded, _note("OPTION_UNMAPPABLE", n_options, " options, ", n_images, " pictures"))))
    return F.struct(reasons.alias("reasons"), notes.alias("notes"))


def post_check(units: Column, n_ads: Column, ink: Column, n_options: Column, narrow: Column | None = None, wide: Column | None = None) -> Column:
    """struct(reasons, notes) from the units (array of struct caption, option_tag, width, height)."""
    none = (F.size(units) == 0) & (n_ads == 0)
    lost = F.coalesce(ink < 0.97, F.lit(False))
    text = lambda u: strip(F.coalesce(u["caption"], F.lit("")))
    cut = F.get(F.filter(units, lambda u: (F.length(text(u)) > 20) & ~F.contains(F.lit(SENTENCE_ENDS), F.right(text(u), F.lit(1)))), F.lit(0))
    odd = F.get(F.filter(units, lambda u: (u["width"] > 0) & (u["height"] > 0) & ((F.least(u["width"], u["height"]) < 24) | (F.greatest(u["width"], u["height"]) > 24 * F.least(u["width"], u["height"])))), F.lit(0))
    inverted = F.coalesce(F.array_max(narrow) >= F.array_min(wide), F.lit(False)) if narrow is not None else F.lit(False)
    tagged = F.size(F.filter(units, lambda u: F.coalesce(u["option_tag"], F.lit("")) != ""))
    reasons = F.when(none, F.array(F.lit("NO_BODY_IMAGE"))).otherwise(_list(
        F.when(lost, F.lit("AREA_LOSS")), F.when(odd.isNotNull(), F.lit("PANEL_GEOMETRY")), F.when(inverted, F.lit("PROXIMITY_INVERTED"))))
    notes = F.when(none, F.array(F.lit("NO_BODY_IMAGE: no unit"))).otherwise(_list(
        F.when(lost, _note("AREA_LOSS", F.format_string("%.3f", ink))), F.when(cut.isNotNull(), _note("CAPTION_TRUNCATED", "…", F.right(text(cut), F.lit(14)))),
        F.when(odd.isNotNull(), _note("PANEL_GEOMETRY", odd["width"], "x", odd["height"])),
        F.when((n_options > 0) & (tagged > 0) & (tagged != n_options), F.concat(n_options.cast("string"), F.lit(" options, "), tagged.cast("string"), F.lit(" tagged units")))))
    return F.struct(reasons.alias("reasons"), notes.alias("notes"))


def verdict(pre: Column, post: Column, missed: Column) -> Column:
    """struct(ok, reasons, notes): reasons after conversion, then missing pictures, then those from before."""
    gone = F.size(missed) > 0
    reasons = F.array_distinct(F.concat(post["reasons"], F.when(gone, F.array(F.lit("IMAGE_MISSING"))).otherwise(F.expr(_NONE)), pre["reasons"]))
    missing = F.array(F.concat(F.lit("IMAGE_MISSING: "), F.size(missed).cast("string"), F.lit(" "), F.array_join(F.slice(missed, 1, 3), ", ")))
    notes = F.concat(pre["notes"], post["notes"], F.when(gone, missing).otherwise(F.expr(_NONE)))
    return F.struct((F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"), notes.alias("notes"))


def hold_histogram(verdicts: DataFrame, reasons: str = "reasons") -> DataFrame:
    return verdicts.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n_products"))


def risk(ok: Column, unread: Column, leftover: Column, n_options: Column, n_units: Column, crops: Column, ink: Column) -> Column:
    """``bad`` if held, ``no`` if something needs a look, else ``ok``."""
    doubt = (unread > 0) | ((n_options > 0) & (leftover > 0)) | ((n_units <= 1) & (crops > 0)) | F.coalesce(ink < 0.9, F.lit(False))
    return F.when(~ok, "bad").when(doubt, "no").otherwise("ok")


def adapter(n_pieces: Column) -> Column:
    return F.when(n_pieces >= 2, "pieces").when(n_pieces == 1, "whole").otherwise("none")
