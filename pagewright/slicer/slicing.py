"""Slicing tall pictures into units of a picture and its captions, as a Spark job.

The pictures are laid down once by their id, and stay where they are: what is found in them is joined to them, and small
helpers read rows and columns of one rectangle at a time.  What follows is relational: sections are a fold over margin
colours; cells are a work list of rectangles, refined level by level and put together again by their paths; groups are
natural breaks of the gaps between bands and rules; the side of the captions is a vote over the whole picture, and units
are picked by maxima within groups.

``images``: image_id long, height int, width int, data binary (RGB by rows); or ``Pictures``, handles whose pixels each step
reads anew in its tasks, so that none are shuffled or written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.lineage import checkpointed
from pagewright.operators.breaks import natural_breaks
from pagewright.slicer import pixels as px
from pagewright.sources.images import png

MIN_SECTION = 24
LEAST_AD = 40
MAX_DEEP = 2  # rows of rows
MAX_LEVELS = 6  # steps of the work list
PICTURES_A_TASK = 250


@dataclass(frozen=True)
class Pictures:
    """Pictures that can be read again: ``rows`` (image_id, height, width and what else ``read`` needs) hold no pixels, and
    ``read(row)`` gives a row's array (height, width, 3).  ``tasks``: how many tasks read them, once laid out by ``by_id``."""

    rows: DataFrame
    read: Callable[[dict], np.ndarray]
    tasks: int | None = None


def _stored(r: dict) -> np.ndarray:
    return px.array_of(r["data"], r["height"], r["width"])


def _handles(images: DataFrame | Pictures) -> Pictures:
    return images if isinstance(images, Pictures) else Pictures(images, _stored)


def _map(df: DataFrame, f, schema: str) -> DataFrame:
    """f(row) -> list of rows, over Arrow batches; schema names the results.  Binary values are views of the batch."""
    step = 1 if "binary" in schema else 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heavy = [n for n, c in zip(batch.schema.names, batch.columns, strict=True) if pa.types.is_binary(c.type)]
            light, views = batch.drop_columns(heavy), {n: batch.column(n) for n in heavy}
            for i in range(0, batch.num_rows, step):
                rows = light.slice(i, step).to_pylist()
                for j, r in enumerate(rows):
                    r |= {n: c[i + j].as_buffer() for n, c in views.items()}
                yield pa.RecordBatch.from_pylist([x for r in rows for x in f(r)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = ", ".join(x.strip() for x in schema.split(";"))
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)
    return df.mapInArrow(run, ddl)


def by_id(images: DataFrame | Pictures) -> DataFrame | Pictures:
    """The pictures, laid down once by their id, so that what is found in them comes to them and they stay where they are.
    Of ``Pictures`` only the handles are, over tasks that grow with their number."""
    if isinstance(images, Pictures):
        if images.tasks:
            return images
        rows = checkpointed(images.rows)
        n = rows.count()
        tasks = max(1, min(n, rows.sparkSession.sparkContext.defaultParallelism), n // PICTURES_A_TASK)
        return Pictures(checkpointed(rows.repartition(tasks, "image_id")), images.read, tasks)
    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(images.select("image_id", "height", "width", "data").repartition(n, "image_id"))


def sections(images: DataFrame | Pictures) -> DataFrame:
    """``image_id, height, width, sections`` (array of y0, y1, colour): ground colours are compared with the first row of
    their run, runs under 24 rows join the one before, a short head the one after."""
    images = _handles(images)
    read = images.read
    margins = _map(images.rows, lambda r: [{"image_id": r["image_id"], "height": r["height"], "width": r["width"], "margins": px.margin_colours(read(r))}], "image_id long; height int; width int; margins array<int>")
    near = " and ".join(f"abs((({{a}} div {1 << s}) & 255) - (({{b}} div {1 << s}) & 255)) <= {px.TOLERANCE}" for s in (16, 8, 0))
    fold = f"""aggregate(margins, named_struct('c', coalesce(get(filter(margins, m -> m is not null), 0), 16777215), 'y', 0, 'out', cast(array() as array<struct<y0:int,y1:int,colour:int>>)),
      (s, m) -> named_struct('c', coalesce(m, s.c), 'y', s.y + 1, 'out',
        case when size(s.out) > 0 and {near.format(a="element_at(s.out, -1).colour", b="coalesce(m, s.c)")}
          then concat(slice(s.out, 1, size(s.out) - 1), array(named_struct('y0', element_at(s.out, -1).y0, 'y1', s.y, 'colour', element_at(s.out, -1).colour)))
          else concat(s.out, array(named_struct('y0', s.y, 'y1', s.y, 'colour', coalesce(m, s.c)))) end),
      s -> s.out)"""
    absorb = f"""aggregate(found, cast(array() as array<struct<y0:int,y1:int,colour:int>>), (out, r) ->
      case when size(out) > 0 and (r.y1 - r.y0 + 1 < {MIN_SECTION} or (size(out) = 1 and out[0].y1 - out[0].y0 + 1 < {MIN_SECTION}))
        then concat(slice(out, 1, size(out) - 1), array(named_struct('y0', element_at(out, -1).y0, 'y1', r.y1, 'colour', if(r.y1 - r.y0 + 1 < {MIN_SECTION}, element_at(out, -1).colour, r.colour))))
        else concat(out, array(r)) end)"""
    return margins.withColumn("found", F.expr(fold)).select("image_id", "height", "width", F.expr(absorb).alias("sections"))


def beside(images: DataFrame | Pictures, other: DataFrame) -> DataFrame:
    """What was found in pictures, joined to them.  The plan's guess of a picture's size is a hundred bytes, so without the
    hint it may send all pixels to all tasks; with it, the findings are hashed by id and the pictures stream past."""
    if isinstance(images, Pictures) and images.tasks:  # few bytes, but heavy work: the planner may not put them into few tasks
        # by the id itself it would be taken for the join's own shuffle if their numbers are equal, and be merged by size
        return images.rows.join(other, "image_id").repartition(images.tasks, F.xxhash64("image_id"))
    return _handles(images).rows.join(other.hint("shuffle_hash"), "image_id")


def _grounds(r: dict, read: Callable[[dict], np.ndarray]):
    """Yields the items of one picture, each with the ``Ground`` of its rows; neighbours share one."""
    page, own, key = read(r), None, None
    for item in sorted(r["items"], key=lambda i: (i["colour"], i["top"], i["end"])):
        if key != (key := (item["colour"], item["top"], item["end"])):
            own = px.Ground(page, *key)
        yield item, own


def _per_picture(images: DataFrame | Pictures, items: DataFrame, look, schema: str) -> DataFrame:
    """``look(item, ground)`` -> rows, for items (image_id, top, end, colour, ...) of the same rows and ground; all items of
    a picture are read together, and only they are shuffled if the pictures lie by id."""
    listed = items.groupBy("image_id").agg(F.collect_list(F.struct(*(c for c in items.columns if c != "image_id"))).alias("items"))
    names = ["image_id", *(x.strip().split()[0] for x in schema.split(";"))]
    read = _handles(images).read
    return _map(beside(images, listed), lambda r: [dict(zip(names, (r["image_id"], *row), strict=True)) for item, own in _grounds(r, read) for row in look(item, own)], f"image_id long; {schema}")


_RECT = "struct<y0:int,y1:int,x0:int,x1:int>"


def cells(images: DataFrame | Pictures, found: DataFrame) -> DataFrame:
    """``image_id, section, cell, col, cols, x0, x1, y0, y1, top, end, colour``: sections taken apart as far as columns are
    found, cells numbered from above.  ``top`` and ``end`` are the section's rows.

    The work list starts with the sections.  A rectangle is cut at the ends of its gutters, else into columns, else into
    rows; strips and rows are looked at again, rows of rows twice at most.  Columns are cells.  Of what has none, a strip
    is a cell, and rows are put together again: neighbours are one cell where another row of their rectangle has columns,
    and the whole rectangle is one cell where none has."""
    todo = found.select("image_id", F.posexplode("sections").alias("section", "s"), "width").select(
        "image_id", "section", F.col("s.y0").alias("top"), F.col("s.y1").alias("end"), "s.colour", F.expr("cast(array() as array<int>)").alias("path"), F.lit("strips").alias("made"), F.lit(0).alias("deep"),
        "s.y0", "s.y1", F.lit(0).alias("x0"), (F.col("width") - 1).alias("x1"))
    keep = ("section", "top", "end", "colour", "path", "made", "deep")

    def refine(item: dict, own: px.Ground) -> Iterator[tuple]:
        how, r, parts = own.refined(tuple(item[c] for c in ("y0", "y1", "x0", "x1")), item["deep"] < MAX_DEEP, item["made"] == "strips" and bool(item["path"]))
        if r is not None:
            yield (*(item[c] for c in keep), how, *r, [dict(zip(("y0", "y1", "x0", "x1"), p, strict=True)) for p in parts])

    schema = f"section int; top int; end int; colour int; path array<int>; made string; deep int; how string; y0 int; y1 int; x0 int; x1 int; parts array<{_RECT}>"
    levels = []
    while len(levels) < MAX_LEVELS:
        levels.append(checkpointed(_per_picture(images, todo, refine, schema)))
        again = levels[-1].where("how in ('strips', 'rows')")
        if again.isEmpty():
            break
        todo = again.select("image_id", "section", "top", "end", "colour", "path", "how", "deep", F.posexplode("parts").alias("i", "p")).select(
            "image_id", "section", "top", "end", "colour", F.concat("path", F.array("i")).alias("path"), F.col("how").alias("made"), (F.col("deep") + (F.col("how") == "rows").cast("int")).alias("deep"), "p.*")
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.union(level)
    keys = ["image_id", "section"]
    # every rectangle above columns, by its path
    above = F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    rich = nodes.where("how = 'columns'").select(*keys, F.explode(above).alias("path")).distinct().withColumn("rich", F.lit(True))
    parent = F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.size("path") - 1))
    seen = nodes.withColumn("parent", parent).join(rich, [*keys, "path"], "left").join(rich.select(*keys, F.col("path").alias("parent"), F.col("rich").alias("rich_parent")), [*keys, "parent"], "left")
    seen = seen.withColumns({"rich": F.coalesce("rich", F.lit(False)), "rich_parent": F.coalesce("rich_parent", F.lit(False))})
    columns = seen.where("how = 'columns'").select(*keys, "top", "end", "colour", F.posexplode("parts").alias("col", "p"), F.size("parts").alias("cols")).select(*keys, "top", "end", "colour", "col", "cols", "p.*")
    poor = seen.where("not rich")
    strips = poor.where("made = 'strips' and (rich_parent or deep = 0) and not (how = 'strips' and deep = 0)")
    # neighbouring rows without columns under a rectangle that has some
    last = F.element_at("path", -1)
    rows = poor.where("made = 'rows' and rich_parent").withColumn("run", last - F.row_number().over(Window.partitionBy(*keys, "parent").orderBy(last)))
    box = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    rows = rows.groupBy(*keys, "top", "end", "colour", "parent", "run").agg(*box)
    names = [*keys, "top", "end", "colour", "col", "cols", "x0", "x1", "y0", "y1"]
    single = strips.select(*keys, "top", "end", "colour", "x0", "x1", "y0", "y1").union(rows.select(*keys, "top", "end", "colour", "x0", "x1", "y0", "y1")).withColumns({"col": F.lit(0), "cols": F.lit(1)})
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("y0", "x0")) - 1
    return columns.select(*names).union(single.select(*names)).withColumn("cell", number)


def islands(images: DataFrame | Pictures, found: DataFrame) -> DataFrame:
    """``image_id, kind, x0, x1, y0, y1`` of the runs of rows of one kind (content, ground, rule) in a trimmed rectangle of
    each picture, ``found (image_id, x0, x1, y0, y1, colour)``; ``above`` and ``below`` are the heights of neighbouring ground."""

    def read(r: dict, own: px.Ground) -> Iterator[tuple]:
        rect = own.trimmed((r["y0"], r["y1"], r["x0"], r["x1"]))
        if rect is None:
            return
        kinds, (first, last) = own.kinds(rect), px.extent(own.free(rect))
        starts = np.flatnonzero(np.diff(kinds, prepend=-1))
        x0, x1 = rect[2] + np.minimum.reduceat(first, starts), rect[2] + np.maximum.reduceat(last, starts)
        y0, y1 = rect[0] + starts, rect[0] + np.append(starts[1:], len(kinds)) - 1
        yield from np.stack([kinds[starts], y0, y1, x0, x1], 1).tolist()

    runs_of = _per_picture(images, found.withColumns({"top": F.col("y0"), "end": F.col("y1")}), read, "kind int; y0 int; y1 int; x0 int; x1 int")
    w = Window.partitionBy("image_id").orderBy("y0")
    tall = F.when(F.col("kind") == 1, F.col("y1") - F.col("y0") + 1).otherwise(0)
    return runs_of.withColumn("tall", tall).withColumn("above", F.coalesce(F.lag("tall").over(w), F.lit(0))).withColumn("below", F.coalesce(F.lead("tall").over(w), F.lit(0))).drop("tall")


def bands(images: DataFrame | Pictures, found: DataFrame) -> DataFrame:
    """``image_id, section, cell, col, x0, x1, y0, y1, gap, ruled``: the content of each cell cut across, parts under 8 rows
    with their nearer neighbour; the distance to the band above, and whether a rule with room on both sides lies between."""
    keys = ["section", "cell", "col"]

    def read(r: dict, own: px.Ground) -> Iterator[tuple]:
        for band in own.bands((r["y0"], r["y1"], r["x0"], r["x1"])):
            yield (*(r[k] for k in keys), *band)

    if "top" not in found.columns:
        found = found.withColumns({"top": F.col("y0"), "end": F.col("y1")})
    parts = _per_picture(images, found, read, "section int; cell int; col int; y0 int; y1 int; x0 int; x1 int; ruled boolean")
    gap = F.col("y0") - F.lag("y1").over(Window.partitionBy("image_id", *keys).orderBy("y0")) - 1
    return parts.select("image_id", *keys, "x0", "x1", "y0", "y1", gap.alias("gap"), "ruled")


def advert_blocks(images: DataFrame | Pictures, regions: DataFrame, least: int = LEAST_AD) -> DataFrame:
    """``image_id, block, x0, x1, y0, y1``: the area above the first unit, cut at rules with room on one side at least;
    blocks lower than ``least`` are left out.  ``regions``: image_id, x0, x1, y0, y1, colour."""
    w = Window.partitionBy("image_id").orderBy("y0")
    cut = ((F.col("kind") == 2) & (F.greatest("above", "below") >= px.BREATH)).cast("int")
    blocks = islands(images, regions).withColumn("block", F.sum(cut).over(w)).where("kind = 0").groupBy("image_id", "block")
    found = blocks.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return found.where(F.col("y1") - F.col("y0") + 1 >= least)


def caption_sides(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``image_id, captions_below``, one side for a page.  Captions inside groups with a picture decide; if as many are
    above as below, the groups of captions at the ends of their cells (there is a picture on one side only); then those
    between two pictures, by the nearer one; below if nothing decides.  ``groups``: keys, g, y0, y1, pictured, inside."""
    w = Window.partitionBy(*keys).orderBy("g")
    over, under, bare = F.col("y0") - F.lag("y1").over(w), F.lead("y0").over(w) - F.col("y1"), F.col("pictured") == 0
    seen = groups.select("image_id", "inside", bare.alias("bare"), over.alias("over"), under.alias("under"))
    end = F.when(F.col("bare"), F.when(F.col("under").isNull() & F.col("over").isNotNull(), 1).when(F.col("over").isNull() & F.col("under").isNotNull(), -1))
    nearer = F.when(F.col("bare"), F.signum(F.col("under") - F.col("over")))
    votes = seen.groupBy("image_id").agg(F.coalesce(F.sum("inside"), F.lit(0)).alias("a"), F.coalesce(F.sum(end), F.lit(0)).alias("b"), F.coalesce(F.sum(nearer), F.lit(0)).alias("c"))
    return votes.select("image_id", F.when(F.col("a") != 0, F.col("a") > 0).when(F.col("b") != 0, F.col("b") > 0).otherwise(F.col("c") >= 0).alias("captions_below"))


def units(images: DataFrame | Pictures) -> DataFrame:
    """``image_id, unit, section, col, x0, x1, y0, y1, n_captions, captions_below, ink, parts`` in reading order.
    ``parts`` are the unit's bands from above (y0, y1, x0, x1)."""
    images = by_id(images)
    found = checkpointed(sections(images))
    keys, stretch = ["image_id", "section", "cell", "col"], ["image_id", "section", "cell", "col", "stretch"]
    parts = bands(images, cells(images, found))
    w = Window.partitionBy(*keys).orderBy("y0")
    # rules part first; breaks of the gaps are looked for between rules
    parts = checkpointed(parts.withColumn("stretch", F.sum(F.col("ruled").cast("int")).over(w)).withColumn("gap", F.when(~F.col("ruled"), F.col("gap"))))
    cut = natural_breaks(parts, stretch).drop("ratio")
    floor = natural_breaks(parts.withColumn("h", F.col("y1") - F.col("y0") + 1), keys, "h").select(*keys, F.coalesce("threshold", F.lit(0)).alias("floor"))
    opens = F.coalesce((F.col("gap") > F.col("threshold")) | F.col("ruled"), F.lit(False)).cast("int")
    grouped = parts.join(cut, stretch, "left").join(floor, keys).withColumn("g", F.sum(opens).over(w))
    tall, in_group = F.col("y1") - F.col("y0") + 1 > F.col("floor"), Window.partitionBy(*keys, "g")
    grouped = grouped.withColumns({"first": F.min(F.when(tall, F.col("y0"))).over(in_group), "last": F.max(F.when(tall, F.col("y1"))).over(in_group)})
    groups = grouped.groupBy(*keys, "g").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.collect_list(F.struct("y0", "y1", "x0", "x1")).alias("parts"), F.max(tall.cast("int")).alias("pictured"),
        F.count("*").alias("n"), (F.count_if(F.col("y0") > F.col("last")) - F.count_if(F.col("y1") < F.col("first"))).alias("inside"))
    voted = groups.join(caption_sides(groups, keys), "image_id")
    # a group without a picture goes to the picture before it, or after it where captions stand above
    down, up = Window.partitionBy(*keys).orderBy("g"), Window.partitionBy(*keys).orderBy(F.desc("g"))
    before, after = F.sum("pictured").over(down), F.sum("pictured").over(up)
    total = F.sum("pictured").over(Window.partitionBy(*keys))
    number = F.when(total == 0, 0).when(F.col("captions_below"), F.greatest(before, F.lit(1))).otherwise(total - F.greatest(after, F.lit(1)) + 1)
    merged = voted.withColumn("u", number).groupBy(*keys, "u", "captions_below").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), (F.sum("n") - 1).alias("n_captions"), F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"))
    # reading order: a unit that starts below the least end of the row begins the next row; as later units start lower
    # still, only the last row can take one
    one = F.array_sort(F.collect_list(F.struct("y0", "x0", "y1", "x1", "section", "col", "n_captions", "parts")))
    page = merged.groupBy("image_id", "captions_below").agg(one.alias("all"))
    fold = """aggregate(all, named_struct('row', 0, 'low', cast(null as int), 'out', cast(array() as array<struct<row:int,x0:int,y0:int,x1:int,y1:int,section:int,col:int,n_captions:bigint,parts:array<struct<y0:int,y1:int,x0:int,x1:int>>>>)), (s, v) ->
      named_struct('row', if(v.y0 <= s.low, s.row, s.row + 1), 'low', if(v.y0 <= s.low, least(s.low, v.y1), v.y1),
        'out', concat(s.out, array(named_struct('row', if(v.y0 <= s.low, s.row, s.row + 1), 'x0', v.x0, 'y0', v.y0, 'x1', v.x1, 'y1', v.y1, 'section', v.section, 'col', v.col, 'n_captions', v.n_captions, 'parts', v.parts)))), s -> array_sort(s.out))"""
    page = checkpointed(page.withColumn("all", F.expr(fold)))

    read = _handles(images).read

    def measure(r: dict) -> list[dict]:
        return [{"image_id": r["image_id"], "ink": px.coverage(read(r), r["sections"], r["boxes"])}]

    boxes = page.select("image_id", F.flatten(F.transform("all", lambda v: v["parts"])).alias("boxes"))
    ink = _map(beside(images, found.select("image_id", "sections").join(boxes, "image_id")), measure, "image_id long; ink double")
    out = page.select("image_id", "captions_below", F.posexplode("all").alias("unit", "v")).join(ink, "image_id")
    return out.select("image_id", "unit", "v.section", "v.col", "v.x0", "v.x1", "v.y0", "v.y1", "v.n_captions", "captions_below", F.round("ink", 6).alias("ink"), "v.parts")


def colours(images: DataFrame | Pictures, boxes: DataFrame, fallback: int = 0x3F8F9B) -> DataFrame:
    """``image_id, unit, chip, plate, light``: an accent, the ground round the rectangle, and whether that is light."""

    pixels = _handles(images).read

    def read(r: dict) -> list[dict]:
        part = pixels(r)[r["y0"] : r["y1"] + 1, r["x0"] : r["x1"] + 1]
        plate = px.plate_colour(part)
        red, green, blue = px.unpack(plate)
        return [{"image_id": r["image_id"], "unit": r["unit"], "chip": px.chip_colour(part, fallback), "plate": plate, "light": 0.299 * red + 0.587 * green + 0.114 * blue > 170}]

    return _map(beside(images, boxes), read, "image_id long; unit int; chip int; plate int; light boolean")


def crops(images: DataFrame | Pictures, boxes: DataFrame, scale: int = 1) -> DataFrame:
    """``image_id, unit, png``: the rectangles ``boxes (image_id, unit, x0, y0, x1, y1)`` as PNG files, each pixel
    ``scale`` times as wide and high (captions are easier to read at 3)."""

    read = _handles(images).read

    def cut(r: dict) -> list[dict]:
        part = read(r)[r["y0"] : r["y1"] + 1, r["x0"] : r["x1"] + 1]
        return [{"image_id": r["image_id"], "unit": r["unit"], "png": png(part.repeat(scale, 0).repeat(scale, 1))}]

    return _map(beside(images, boxes.select("image_id", "unit", "x0", "y0", "x1", "y1")), cut, "image_id long; unit int; png binary")


def contact_sheets(images: DataFrame | Pictures, found: DataFrame) -> DataFrame:
    """``image_id, png``: every picture with its units framed in red."""
    boxes = found.groupBy("image_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))

    read = _handles(images).read

    def draw(r: dict) -> list[dict]:
        page = read(r).copy()
        for b in r["boxes"]:
            page[b["y0"] : b["y1"] + 1, [b["x0"], b["x1"]]] = (220, 30, 30)
            page[[b["y0"], b["y1"]], b["x0"] : b["x1"] + 1] = (220, 30, 30)
        return [{"image_id": r["image_id"], "png": png(page)}]

    return _map(beside(images, boxes), draw, "image_id long; png binary")


def report(found: DataFrame) -> DataFrame:
    """One JSON text for each picture."""
    unit = F.struct("unit", "section", "col", "x0", "y0", "x1", "y1", "n_captions")
    return found.groupBy("image_id", "ink").agg(F.array_sort(F.collect_list(unit)).alias("units")).select("image_id", F.to_json(F.struct("image_id", "ink", "units")).alias("json"))


def from_image_source(found: DataFrame) -> DataFrame:
    """Pictures of Spark's image source (column ``image``, BGR) in the shape used here; ``image_id`` hashes the origin."""

    def turn(r: dict) -> list[dict]:
        i = r["image"]
        bgr = np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["nChannels"])
        if i["nChannels"] == 1:
            bgr = np.repeat(bgr, 3, 2)
        return [{"image_id": r["image_id"], "height": i["height"], "width": i["width"], "data": np.ascontiguousarray(bgr[:, :, 2::-1]).tobytes()}]

    return _map(found.select(F.xxhash64("image.origin").alias("image_id"), "image"), turn, "image_id long; height int; width int; data binary")
