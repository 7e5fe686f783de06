"""The batch: products of a workbook to units, verdicts and pages, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import guess_specs, has_caption
from pagewright.lineage import checkpointed
from pagewright.operators import gate, render, whole
from pagewright.operators.match import tag_unit
from pagewright.slicer import slicing
from pagewright.sources import html


UNITS = "array<struct<url:string,caption:string,caption_crop:string,option_tag:string,width:int,height:int>>"


def taken_apart(images: DataFrame | slicing.Pictures, least_ad: int = slicing.LEAST_AD) -> DataFrame:
    """``picture, ads, units, ink`` of tall pictures ``images (url, image_id, height, width, data)``, each once.  A part
    is named by the picture's URL and its rectangle (``#xywh=``), which ``slicing.crops`` cuts out."""
    if isinstance(images, slicing.Pictures):
        pixels = images = slicing.by_id(images)
        urls = images.rows.select("image_id", "url")
    else:
        pixels, urls = images.select("image_id", "height", "width", "data"), images.select("image_id", "url")
    slices = checkpointed(slicing.units(pixels))
    boxes = whole.adapted(pixels, slices, least_ad).join(urls, "image_id")
    size = lambda a, b: F.col(b) - F.col(a) + 1
    part = lambda k: F.concat("url", F.lit("#xywh="), F.concat_ws(",", f"{k}x0", f"{k}y0", size(f"{k}x0", f"{k}x1"), size(f"{k}y0", f"{k}y1")))
    crop = F.when(F.col("cx0").isNotNull(), part("c")).otherwise("")
    unit = F.struct("pos", part("").alias("url"), crop.alias("crop"), size("x0", "x1").alias("width"), size("y0", "y1").alias("height"))
    every = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, unit)))
    ink = slices.groupBy("image_id").agg(F.max("ink").alias("ink"))
    found = boxes.groupBy("image_id", F.col("url").alias("picture")).agg(every("ad").alias("ads"), every("unit").alias("units")).join(ink, "image_id", "left")
    ads = F.transform("ads", lambda a: F.struct(a["url"].alias("url"), a["width"].alias("width")))
    units = F.transform("units", lambda u: F.struct(u["url"].alias("url"), F.lit("").alias("caption"), u["crop"].alias("caption_crop"), F.lit("").alias("option_tag"), u["width"].alias("width"), u["height"].alias("height")))
    return found.select("picture", ads.alias("cut_ads"), units.alias("cut_units"), "ink")


def convert(rows: DataFrame, sizes: DataFrame | None = None, base: str = "https://localhost/", images: DataFrame | slicing.Pictures | None = None, least_ad: int = slicing.LEAST_AD) -> DataFrame:
    """``rows`` (code, name, brand, category, body, options) with ads, units, specs, lead, intro and verdict.

    ``sizes`` (url, width, height) are the pictures that could be read: pieces without one are reported as missing, and
    only the others decide where the adverts end.  ``images`` (url, image_id, height, width, data; each URL and id once)
    holds pixels, or handles of them: a product of one picture that is among them is taken apart by slicing.  The pre-gate runs on the sheet alone, before pictures are joined."""
    c = F.col
    flat = lambda name: F.flatten(F.transform("options", lambda o: o[name]))
    found = html.bodies(rows, "body", base).withColumns({"option_names": flat("values"), "option_numbers": flat("numbers")})
    found = found.withColumn("pre", gate.pre_gate(F.size("pieces"), F.size(F.filter("pieces", lambda p: has_caption(p["caption"]))), F.size("option_names")))
    if sizes is None:
        sized = F.transform("pieces", lambda p: F.struct(p["pos"].alias("pos"), p["url"].alias("url"), p["caption"].alias("caption"), F.lit(0).alias("width"), F.lit(0).alias("height")))
        found = found.withColumn("got", sized).withColumn("missed", F.expr("cast(array() as array<string>)"))
    else:
        each = found.where(F.size("pieces") > 0).select("code", F.explode("pieces").alias("p")).select("code", "p.*")
        known = sizes.select("url", "width", "height").dropDuplicates(["url"])
        piece = F.struct("pos", "url", "caption", "width", "height")
        joined = each.join(known, "url", "left").groupBy("code").agg(
            F.array_sort(F.collect_list(F.when(c("width").isNotNull(), piece))).alias("got"), F.array_sort(F.collect_list(F.when(c("width").isNull(), c("url")))).alias("missed"))
        none = "cast(array() as array<struct<pos:int,url:string,caption:string,width:int,height:int>>)"
        found = found.join(joined, "code", "left").withColumn("got", F.coalesce("got", F.expr(none))).withColumn("missed", F.coalesce("missed", F.expr("cast(array() as array<string>)")))
    first = F.array_min(F.transform(F.filter("got", lambda p: has_caption(p["caption"])), lambda p: p["pos"]))
    found = found.withColumn("first", first).withColumn("ads", F.transform(F.filter("got", lambda p: c("first").isNull() | (p["pos"] < c("first"))), lambda p: F.struct(p["url"].alias("url"), p["width"].alias("width"))))

    def unit(p):
        tagged = tag_unit(p["caption"], c("option_names"))
        return F.struct(p["url"].alias("url"), tagged["caption"].alias("caption"), F.lit("").alias("caption_crop"), tagged["option_tag"].alias("option_tag"), p["width"].alias("width"), p["height"].alias("height"))

    found = found.withColumn("units", F.transform(F.filter("got", lambda p: p["pos"] >= c("first")), unit)).withColumn("units", F.coalesce("units", F.expr(f"cast(array() as {UNITS})")))
    if images is None:
        found = found.withColumn("ink", F.lit(None).cast("double"))
    else:
        found = found.withColumn("picture", F.when(F.size("pieces") == 1, F.get("pieces", F.lit(0))["url"]))
        wanted = found.select(c("picture").alias("url")).distinct()
        if isinstance(images, slicing.Pictures):
            own = slicing.Pictures(images.rows.join(wanted, "url", "left_semi"), images.read)
        else:
            own = checkpointed(images.join(wanted, "url", "left_semi"))
        cut = c("cut_units").isNotNull()
        found = found.join(taken_apart(own, least_ad), "picture", "left").withColumns({"ads": F.when(cut, c("cut_ads")).otherwise(c("ads")), "units": F.when(cut, c("cut_units")).otherwise(c("units"))})
    post = gate.post_check(c("units"), F.size("ads"), c("ink"), F.size("option_names"))
    early = F.size("pieces") == 0
    verdict = F.when(early, F.struct(F.lit(False).alias("ok"), c("pre.reasons").alias("reasons"), c("pre.notes").alias("notes"))).otherwise(gate.verdict(c("pre"), post, c("missed")))
    lead = F.array_join(F.transform("lead_blocks", lambda b: b["text"]), " ")
    lines = F.concat(F.transform("units", lambda u: u["caption"]), F.array(lead), F.transform("lead_blocks", lambda b: b["text"]))
    tags = F.size(F.array_distinct(F.transform(F.filter("units", lambda u: u["option_tag"] != ""), lambda u: u["option_tag"])))
    count = F.when(F.size("option_names") > 0, F.size("option_names")).otherwise(tags)
    return found.select(
        "code", "name", "brand", "category", lead.alias("lead"), guess_specs(lines, count).alias("specs"), c("lead_blocks").alias("intro"), "ads", "units", c("option_names").alias("options"),
        "option_numbers", verdict.alias("verdict"), "ink", gate.adapter(F.size("pieces")).alias("adapter"),
    )


def unit_rows(converted: DataFrame) -> DataFrame:
    """A row for each unit with its product and verdict; a product without units has one row without a place."""
    head = ["code", "adapter", "verdict.ok", "verdict.reasons", "verdict.notes", "ink", "name", "brand", "category", "lead", "ads"]
    return converted.select(*head, F.posexplode_outer("units").alias("pos", "u")).select("*", "u.*").drop("u")


def pages(converted: DataFrame) -> DataFrame:
    """``code, html`` of the products that passed the gate."""
    return render.pages(converted.where("verdict.ok"))
