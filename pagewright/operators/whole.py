"""Pages that are one tall picture: from its slices to adverts, units and the captions drawn in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.lineage import checkpointed
from pagewright.operators.breaks import natural_breaks
from pagewright.operators.products import attach_scraps
from pagewright.slicer import slicing

# fixed values
TEXT_SHARE = 0.3  # a band of text has at most this share of its unit's tallest band
LEAST_TEXT = 6  # rows of a line of text above a picture
FLAT = 8  # a heading is wider than this many times its height

EDGES = ("x0", "y0", "x1", "y1")


def _height(p: Column) -> Column:
    return p["y1"] - p["y0"] + 1


def _thin(parts: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(F.lit(TEXT_SHARE) * F.array_max(F.transform(parts, _height))))


def _leading(parts: Column, match: Callable[[Column], Column]) -> Column:
    """How many bands from above match; one always stays."""
    other = F.array_min(F.transform(parts, lambda p, i: F.when(~match(p), i)))
    return F.least(F.coalesce(other, F.size(parts)), F.size(parts) - 1)


def _trailing(parts: Column, match: Callable[[Column], Column]) -> Column:
    other = F.array_max(F.transform(parts, lambda p, i: F.when(~match(p), i)))
    return F.size(parts) - 1 - F.coalesce(other, F.lit(0))


def _first(parts: Column, n: Column) -> Column:
    return F.slice(parts, F.lit(1), n)


def _last(parts: Column, n: Column) -> Column:
    return F.slice(parts, F.size(parts) - n + 1, n)


def split_parts(slices: DataFrame) -> DataFrame:
    """``slices`` with their bands taken apart into ``art`` and ``caps``.  The side of the captions is the page's: below
    its picture if any unit ends in a band of text, or none begins with one.  Flat bands of text at the other end of a
    unit are headings and belong to neither."""
    parts, art = F.col("parts"), F.col("art")
    seen = slices.withColumn("thin", _thin(parts)).withColumn("n_tail", _trailing(parts, lambda p: _height(p) <= F.col("thin")))
    seen = seen.withColumn("n_head", _leading(parts, lambda p: _height(p).between(LEAST_TEXT, F.col("thin"))))
    side = seen.groupBy("image_id").agg(((F.count_if(F.col("n_tail") > 0) > 0) | (F.count_if(F.col("n_head") > 0) == 0)).alias("below"))
    n = F.size("parts")
    cut = seen.join(side, "image_id").withColumns({
        "caps": F.when(F.col("below"), _last(parts, F.col("n_tail"))).otherwise(_first(parts, F.col("n_head"))),
        "art": F.when(F.col("below"), _first(parts, n - F.col("n_tail"))).otherwise(_last(parts, n - F.col("n_head"))),
    }).withColumn("thin", _thin(art))
    heading = lambda p: _height(p).between(LEAST_TEXT, F.col("thin")) & (p["x1"] - p["x0"] + 1 > FLAT * _height(p))
    rest = F.when(F.col("below"), _last(art, F.size(art) - _leading(art, heading))).otherwise(_first(art, F.size(art) - _trailing(art, heading)))
    return cut.withColumn("art", rest).drop("thin", "n_tail", "n_head", "below")


def _union(prefix: str, role: str) -> list[Column]:
    return [(F.min if e.endswith("0") else F.max)(F.when(F.col("role") == role, F.col(e))).alias(prefix + e) for e in EDGES]


def _placed(main: DataFrame) -> DataFrame:
    """Units below the adverts, each with its box and the box of its captions (null without).  Slices of the lower kind of
    height are scraps: beside a picture they are part of it, farther off than their own height its caption."""
    height = F.col("y1") - F.col("y0") + 1
    floor = natural_breaks(main.withColumn("h", height), ["image_id"], "h").select("image_id", F.coalesce("threshold", F.lit(0)).alias("floor"))
    kinds = main.join(floor, "image_id").withColumn("solid", height > F.col("floor"))
    widest = F.array_max(F.transform("art", lambda p: F.struct(((p["x1"] - p["x0"] + 1) * _height(p)).alias("area"), (-p["y0"]).alias("up"), p.alias("box"))))["box"]
    solids = kinds.where("solid").withColumn("widest", widest)
    scraps = kinds.where("not solid").select("image_id", F.col("unit").alias("pos"), *EDGES)
    pictures = solids.select("image_id", F.col("unit").alias("pos"), *(F.col("widest")[e].alias(e) for e in EDGES))
    homes = attach_scraps(scraps, pictures, "image_id").withColumnsRenamed({"scrap_pos": "pos", "picture_pos": "unit"})
    beside = pictures.select("image_id", F.col("pos").alias("unit"), F.col("x0").alias("left"), F.col("x1").alias("right"))
    away = F.greatest(F.col("left") - F.col("x1"), F.col("x0") - F.col("right"), F.lit(0))
    added = homes.join(scraps, ["image_id", "pos"]).join(beside, ["image_id", "unit"]).withColumn("role", F.when(away > height, "said").otherwise("drawn"))
    added = added.groupBy("image_id", "unit").agg(*_union("d", "drawn"), *_union("s", "said"))
    caps = [(F.array_min if e.endswith("0") else F.array_max)(F.col("caps")[e]).alias("c" + e) for e in EDGES]
    own = solids.select("image_id", "unit", "x0", F.get("art", F.lit(0))["y0"].alias("y0"), "x1", F.element_at("art", -1)["y1"].alias("y1"), *caps)
    both = own.join(added, ["image_id", "unit"], "left")
    pick = lambda a, b: (F.least if a.endswith("0") else F.greatest)(a, b).alias(a)
    # a caption as wide as its picture or less is cut at the picture's width
    joined = both.select("image_id", "unit", F.col("x0").alias("left"), F.col("x1").alias("right"), *(pick(e, "d" + e) for e in EDGES), *(pick("c" + e, "s" + e) for e in EDGES))
    within = (F.col("cx0") >= F.col("left")) & (F.col("cx1") <= F.col("right"))
    return joined.withColumns({"cx0": F.when(within, F.col("left")).otherwise(F.col("cx0")), "cx1": F.when(within, F.col("right")).otherwise(F.col("cx1"))}).drop("left", "right")


def merged_rows(units: DataFrame) -> DataFrame:
    """Neighbours in reading order that overlap in height and have no caption (``cx0`` is null) are one unit."""
    w = Window.partitionBy("image_id").orderBy("unit")
    bare = F.col("cx0").isNull()
    same = bare & F.lag(bare).over(w) & (F.col("y0") <= F.lag("y1").over(w)) & (F.lag("y0").over(w) <= F.col("y1"))
    grouped = units.withColumn("_new", F.coalesce((~same).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(w))
    every = [(F.min if e.endswith("0") else F.max)(e).alias(e) for e in (*EDGES, *("c" + e for e in EDGES))]
    return grouped.groupBy("image_id", "_g").agg(F.min("unit").alias("unit"), *every).drop("_g")


def adapted(images: DataFrame | slicing.Pictures, slices: DataFrame, least_ad: int = slicing.LEAST_AD) -> DataFrame:
    """``image_id, role, pos, x0, y0, x1, y1, cx0, cy0, cx1, cy1``: from the first slice with a caption on, slices are units
    (``unit``) with the box of their captions; what stands above is cut at its rules into adverts (``ad``).  A picture
    without captions, or of which fewer than half of the units have one, is all adverts.
    ``slices``: as ``slicing.units`` gives them."""
    if isinstance(images, slicing.Pictures):
        images = slicing.by_id(images)
    cut = checkpointed(split_parts(slices.select("image_id", "unit", *EDGES, "parts")))
    first = cut.where(F.size("caps") > 0).groupBy("image_id").agg(F.min_by("y0", "unit").alias("first"))
    rows = merged_rows(_placed(cut.join(first, "image_id").where("y0 >= first")))
    rows = checkpointed(rows.withColumn("pos", F.row_number().over(Window.partitionBy("image_id").orderBy("unit")) - 1))
    split = rows.groupBy("image_id").agg((F.count_if(F.col("cx0").isNotNull()) * 2 >= F.count("*")).alias("split")).where("split").select("image_id")
    low = F.coalesce(F.col("first"), F.col("height")) - 1
    tops = slicing.sections(images).join(split.join(first, "image_id"), "image_id", "left").select(
        "image_id", F.lit(0).alias("x0"), (F.col("width") - 1).alias("x1"), F.lit(0).alias("y0"), low.alias("y1"), F.get("sections", F.lit(0))["colour"].alias("colour"))
    ads = slicing.advert_blocks(images, tops.where("y1 >= y0"), least_ad)
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("y0")) - 1
    none = [F.lit(None).cast("int").alias("c" + e) for e in EDGES]
    found = rows.join(split, "image_id", "left_semi").select("image_id", F.lit("unit").alias("role"), "pos", *EDGES, *("c" + e for e in EDGES))
    return ads.select("image_id", F.lit("ad").alias("role"), place.alias("pos"), *EDGES, *none).unionByName(found)
