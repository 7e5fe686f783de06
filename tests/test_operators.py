import random

import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import breaks, diff, gate, products, refine, render
from pagewright.plans import drawings
from pagewright.slicer import slicing
from pagewright.sources import html as html_source
from pagewright.sources import images, runs, xlsx


def _breaks(gaps):
    """Plain version: (threshold, ratio)."""
    values = sorted(set(gaps))
    best, low = 1.0, None
    for a, b in zip(values, values[1:]):
        if low is None or (b + 2) / (a + 2) > best:
            best, low = (b + 2) / (a + 2), a
    return (low if low is not None and best >= 2 else None), best


def test_natural_breaks_against_plain_version(spark):
    r = random.Random(4)
    cases = [[6, 4, 24, 6, 4, 24, 6, 4], [6, 4, 4], [12, 12], [31], [0, 0, 1, 0], *([r.choice([0, 1, 3, 9, 30, 100]) for _ in range(r.randrange(1, 9))] for _ in range(40))]
    rows = spark.createDataFrame([(k, g) for k, c in enumerate(cases) for g in c], "k int, gap int")
    found = {x.k: (x.threshold, round(x.ratio, 9)) for x in breaks.natural_breaks(rows, ["k"]).collect()}
    assert found == {k: (_breaks(c)[0], round(_breaks(c)[1], 9)) for k, c in enumerate(cases)}


def test_groups_do_not_depend_on_buckets(spark):
    rows = spark.createDataFrame([(1, i, g) for i, g in enumerate([None, 4, 6, 24, 4, 6, 30, 4])], "k int, i int, gap int")
    for bucket in (None, F.floor(F.col("i") / 3)):
        found = breaks.group_by_breaks(rows, ["k"], ["i"], bucket=bucket).orderBy("i").collect()
        assert [x.group_no for x in found] == [0, 0, 0, 1, 1, 1, 2, 2]


def test_gate(spark):
    unit = "array<struct<caption:string,option_tag:string,width:int,height:int>>"
    df = spark.createDataFrame([
        (1, 0, 0, 0, None, [], []), (2, 9, 0, 10, 0.99, [("a long caption without an end", "", 30, 30)], []),
        (3, 9, 0, 0, 0.9, [("ok.", "", 10, 300)], ["u1", "u2", "u3", "u4"]), (4, 3, 3, 0, None, [("fine.", "", 30, 30)], []),
    ], f"code int, n_images int, n_captions int, n_options int, ink double, units {unit}, missed array<string>")
    pre = gate.pre_gate(F.col("n_images"), F.col("n_captions"), F.col("n_options"))
    post = gate.post_check(F.col("units"), F.lit(0), F.col("ink"), F.col("n_options"))
    v = {r.code: r.v for r in df.select("code", gate.verdict(pre, post, F.col("missed")).alias("v")).collect()}
    assert v[1].reasons == ["NO_BODY_IMAGE"] and not v[1].ok
    assert v[2].reasons == ["OPTION_UNMAPPABLE"] and any(n.startswith("CAPTION_TRUNCATED: …") for n in v[2].notes)
    assert v[3].reasons == ["AREA_LOSS", "PANEL_GEOMETRY", "IMAGE_MISSING"] and "IMAGE_MISSING: 4 u1, u2, u3" in v[3].notes
    assert any(n.startswith("NO_CAPTION_MULTI_IMG") for n in v[3].notes)
    assert v[4].ok and v[4].notes == []


def test_overrides_keep_empty_values(spark):
    units = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "code int, pos int, caption string")
    typed = spark.createDataFrame([(1, 0, ""), (1, 1, None)], "code int, pos int, caption string")
    found = products.merge_overrides(units, typed, ["code", "pos"], ["caption"])
    assert {(r.code, r.pos): r.caption for r in found.collect()} == {(1, 0): "", (1, 1): "b", (2, 0): "c"}


def test_corrections_match_tags_again(spark):
    """New captions are matched with the sheet, unless a tag was typed for the product; others stay as they are."""
    unit = "code string, pos int, caption string, option_tag string"
    units = spark.createDataFrame([("a", 0, "old", ""), ("a", 1, "kept", "red"), ("b", 0, "[red] x", ""), ("c", 0, "[red] x", "")], unit)
    typed = spark.createDataFrame([("a", 0, "[1. red] soft", None), ("b", 0, None, "blue")], unit)
    options = spark.createDataFrame([(k, ["red", "blue"]) for k in "abc"], "code string, options array<string>")
    found = {(r.code, r.pos): (r.caption, r.option_tag) for r in products.corrected(units, typed, options).collect()}
    assert found == {("a", 0): ("soft", "red"), ("a", 1): ("kept", "red"), ("b", 0): ("[red] x", "blue"), ("c", 0): ("[red] x", "")}
    specs = spark.sql("select array(named_struct('k', 'x', 'v', '1', 'u', 'g')) g, s from values ('233g'), (''), (null) t(s)")
    assert [[x.v for x in r.got] for r in specs.select(products.corrected_specs(F.col("s"), F.col("g")).alias("got")).collect()] == [["233"], ["1"], ["1"]]


def test_unit_rows(spark):
    from pagewright.plans import convert

    options = "cast(array() as array<struct<name:string,values:array<string>,numbers:array<string>>>) options"
    rows = spark.sql(f"select code, 'n' name, '' brand, '' category, body, {options} from values ('a', '<div><img src=\"/u.png\">said here.</div><p><img src=\"/v.png\"></p>'), ('b', '<p>x</p>') t(code, body)")
    found = convert.unit_rows(convert.convert(rows)).orderBy("code", "pos").collect()
    assert [(r.code, r.pos, r.adapter) for r in found][-1] == ("b", None, "none") and [r.pos for r in found if r.code == "a"] == list(range(len(found) - 1)) and not found[-1].ok


def test_guard(spark):
    cases = [
        ("weighs 40 g now", "weighs 41 g now", "weighs 40 g now"), ("a b c d e f", "something quite different", "a b c d e f"), ("keep", "", "keep"), ("", " new ", "new"),
        ("soft inner wall", "soft **inner wall**", "soft **inner wall**"), ("soft inner wall", "soft **inner** wall", "soft inner wall"), ("soft inner wall", "**soft inner wall", "soft inner wall"),
        ("soft inner wall is here", "soft **inner hall** is here", "soft inner hall is here"),
    ]
    rows = spark.createDataFrame(cases, "a string, b string, c string")
    for r in rows.select(refine.guard(F.col("a"), F.col("b")).alias("got"), "c").collect():
        assert r.got == r.c


def test_fill_slots(spark):
    units = spark.createDataFrame([("p", 0, "old text one", ""), ("p", 1, " ", ""), ("p", 2, "", "crop.png")], "code string, pos int, caption string, caption_crop string")
    answers = spark.createDataFrame([("p", '["old text ones", "seen in the picture"]')], "code string, answer string")
    found = {r.pos: (r.caption, r.kept) for r in refine.fill(refine.slots(units), units, answers).collect()}
    assert found == {0: ("old text ones", False), 2: ("seen in the picture", False)}


def _product(**given):
    unit = lambda url, caption="", tag="", crop="", width=0: {"url": url, "caption": caption, "caption_crop": crop, "option_tag": tag, "width": width}
    base = {"code": "100", "name": "Desk lamp", "brand": "", "category": "light", "lead": "", "specs": [], "intro": [], "ads": [], "units": [], "options": [], "option_numbers": []}
    return base | given | {"units": [unit(*u) for u in given.get("units", [])]}


PRODUCT = (
    "code string, name string, brand string, category string, lead string, specs array<struct<k:string,v:string,u:string>>, intro array<struct<text:string,strong:boolean>>, ads array<struct<url:string,width:int>>, "
    "units array<struct<url:string,caption:string,caption_crop:string,option_tag:string,width:int>>, options array<string>, option_numbers array<string>"
)


def test_parts_of_pages(spark):
    rows = [
        _product(code="a", ads=[("x.png", 400), ("y.png", 800)], units=[("u.png",), ("v.png",)], lead="Desk lamp. Warm light for long evenings."),
        _product(code="b", brand="Lumo", ads=[("x.png", 100), ("y.png", 50)], units=[("u.png", "Small <base>. It stands firm.", "", "", 50), ("v.png", "red one", "red"), ("w.png", "", "red")], options=["red", "blue"], intro=[("long " * 20, True), ("A lamp", True)]),
        _product(code="c", name="", specs=[("", "3", "kg")], units=[("w.png", "only one", "red")], options=["red"]),
    ]
    products = spark.createDataFrame(rows, PRODUCT)
    found = {(r.code, r.part): [(e.role, e.note, e.text, e.url, e.width) for e in r.entries] for r in render.parts(products).collect()}
    names = {c: [p for k, p in found if k == c] for c in "abc"}
    assert names["a"] == ["opening", "posters", "story", "scenes", "closing"] or set(names["a"]) == {"opening", "posters", "scenes", "closing"}
    assert [e[0] for e in found["a", "posters"]] == ["poster", "poster"] and found["a", "posters"][0][4] == 400 and found["a", "posters"][1][4] is None
    assert [e[0] for e in found["a", "scenes"]] == ["picture", "picture"] and ("lead", None, "Warm light for long evenings.", None, None) in found["a", "opening"]
    assert set(names["b"]) == {"opening", "typed", "choices", "more_posters", "choice_views", "scenes", "closing"}
    assert found["b", "opening"][0][:3] == ("maker", None, "Lumo") and found["b", "opening"][-1][3] == "x.png"
    assert [e[0] for e in found["b", "typed"]] == ["line", "tagline"]
    assert [(e[0], e[3]) for e in found["b", "choices"]] == [("choice", "v.png"), ("bare_choice", None)] and [e[0] for e in found["b", "choice_views"]] == ["view_head", "view", "view"]
    assert found["b", "scenes"] == [("scene_left", "Small <base>", "It stands firm.", "u.png", None)] or found["b", "scenes"][0][0] == "scene_left"
    assert set(names["c"]) == {"opening", "measures", "choices", "closing"} and found["c", "measures"] == [("measure", "", "3kg", None, None)]
    html = {r.code: r.html for r in render.pages(products).collect()}
    assert len(html) == 3 and "<base>" not in html["b"] and "&lt;base&gt;" in html["b"] and html["b"].count("<section ") == len(names["b"])
    o = {r.code: r.o for r in spark.createDataFrame(list(html.items()), "code string, html string").select("code", diff.outline(F.col("html")).alias("o")).collect()}
    assert o["b"].parts == [p for p in render.PARTS if ("b", p) in found] and len(o["b"].choices) == 2 and o["c"].measures == ["3kg"]


def test_saved_pages_come_back(spark, tmp_path):
    """Sinks and sources of runs: pages by code, archives, outlines, lists and exports; no page is lost by its code."""
    import zipfile

    pages = spark.createDataFrame([("7001", "<main>a\n</main>"), ("bad/../code", "<main>b</main>"), (None, "<main>c</main>")], "code string, html string")
    runs.save_pages(pages, str(tmp_path / "out"))
    listed = [r.code for r in runs.made(spark, str(tmp_path / "out")).collect()]
    assert "7001" in listed and len(set(listed)) == 3 and all(c == "7001" or c.startswith("page-") for c in listed)
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "9.html").write_text("<main>x</main>", "utf-8")
    with zipfile.ZipFile(tmp_path / "run.zip", "w") as z:
        z.writestr("sub/9.html", "<main>x</main>")
        z.writestr("note.txt", "no page")
    kept = [[(r.code, r.html) for r in f(spark, str(tmp_path / d)).collect()] for f, d in ((runs.pages_of, "flat"), (runs.pages_in_zips, "run.zip"))]
    assert kept[0] == kept[1] == [("9", "<main>x</main>")]
    shaped = runs.shapes(runs.pages_of(spark, str(tmp_path / "flat")))
    runs.save_shapes(shaped, str(tmp_path / "shapes"))
    back = runs.read_shapes(spark, str(tmp_path / "shapes"), shaped)
    assert [r.state for r in diff.compare(shaped, back).collect()] == ["same"]
    wanted = spark.createDataFrame([("9",), (" ",)], "code string")
    assert [r.code for r in runs.export(runs.pages_of(spark, str(tmp_path / "flat")), wanted).collect()] == ["9"]
    assert [r.code for r in runs.export(pages.where("code is not null")).collect()] == ["7001", "bad/../code"]


def test_run_comparison(spark):
    page = lambda name, n: f'<main><section data-part="choices"><div data-role="choice"><h2>{name}</h2></div>' + '<div data-role="bare_choice"></div>' * n + "</section></main>"
    old = spark.createDataFrame([("a", page("x", 1)), ("b", page("x", 1)), ("c", page("x", 1))], "code string, html string")
    new = spark.createDataFrame([("a", page("x", 1).replace("</h2>", "</h2>\r")), ("b", page("y", 2)), ("d", page("x", 1))], "code string, html string")
    shaped = [d.select("code", diff.outline(F.col("html")).alias("shape")) for d in (old, new)]
    found = {r.code: (r.state, r.parts) for r in diff.compare(*shaped).collect()}
    assert found == {"a": ("same", None), "b": ("changed", ["roles", "choices", "text"]), "c": ("only_old", None), "d": ("only_new", None)}
    change = spark.createDataFrame([("abc def", "abc xyz")], "a string, b string").select(diff.text_change(F.col("a"), F.col("b")).alias("c")).first().c
    assert change.ratio == 0.571 and change.changes[0].old == "def"


def test_bodies(spark):
    html = '<p>머리 <b>굵게</b></p><script>x</script><!-- no --><p>배송 안내</p><div>one<br>two</div><table><tr><td><img src="/a.jpg"></td><td>cap A</td></tr></table><img src="http://h/x.jpg"><img>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>only text</p><p>only text</p>")], "id int, html string")
    found = {r.id: r for r in html_source.bodies(df).collect()}
    assert [p.url for p in found[1].pieces] == ["https://localhost/a.jpg", "http://h/x.jpg"] and found[1].pieces[0].caption == "cap A" and len(found[1].broken) == 1
    assert [(b.text, b.strong) for b in found[1].lead_blocks] == [("머리 굵게", True), ("one\ntwo", False)]
    assert found[2].pieces == [] and [b.text for b in found[3].lead_blocks] == ["only text"]


def test_workbook_with_shuffled_and_repeated_headers(spark):
    from pagewright.plans.queries import _workbook

    books = spark.createDataFrame([("a", _workbook([("1001", "n", "b", "색=빨강", "<p>x</p>"), ("", "", "b", "", "")]))], "path string, content binary")
    found = xlsx.products(xlsx.cells(books)).collect()
    assert len(found) == 1 and found[0].code == "1001" and found[0].options[0]["values"] == ["빨강"]
    cells = spark.createDataFrame([("w", 0, 0, "엉뚱한열"), ("w", 0, 1, "상품명"), ("w", 0, 2, "상품명"), ("w", 1, 1, "first"), ("w", 1, 2, "last")], "path string, row int, col int, value string")
    assert [r.name for r in xlsx.products(cells).collect()] == ["last"]
    assert sorted(r.field for r in xlsx.missing_fields(cells, xlsx.header_columns(cells)).collect()) == ["body", "code"]


def test_slicing_finds_every_cell(spark):
    pages = [drawings.grid_picture(n, seed=n) for n in (2, 4)]
    df = spark.createDataFrame([(i, p.shape[0], p.shape[1], bytearray(p.tobytes())) for i, p in enumerate(pages)], "image_id long, height int, width int, data binary")
    found = slicing.units(df).orderBy("image_id", "unit").collect()
    for i, n in enumerate((2, 4)):
        mine = [r for r in found if r.image_id == i]
        assert len(mine) == 1 + 2 * n and [r.col for r in mine[1:]] == [0, 1] * n
        assert all(r.n_captions == 1 and r.captions_below for r in mine[1:]) and mine[0].ink > 0.99


def test_sections_follow_the_ground(spark):
    page = np.full((300, 80, 3), 255, np.uint8)
    page[150:] = 10
    page[40:50, 30:60] = 99
    df = spark.createDataFrame([(7, 300, 80, bytearray(page.tobytes()))], "image_id long, height int, width int, data binary")
    assert [(s.y0, s.y1) for s in slicing.sections(df).first().sections] == [(0, 149), (150, 299)]


def test_adverts_crops_and_colours(spark):
    page = np.full((200, 80, 3), 255, np.uint8)
    page[10:60, 10:70], page[70:72], page[80:130, 10:70], page[150:160, 10:70] = (200, 20, 20), 0, (20, 200, 20), (9, 9, 9)
    page[10:60:3, 10:70] = (180, 30, 30)
    page[80:130:3, 10:70] = (30, 180, 30)
    page[100, 12:60] = 7
    df = spark.createDataFrame([(1, 200, 80, bytearray(page.tobytes()))], "image_id long, height int, width int, data binary")
    area = spark.createDataFrame([(1, 0, 79, 0, 199, 0xFFFFFF)], "image_id long, x0 int, x1 int, y0 int, y1 int, colour int")
    blocks = slicing.advert_blocks(df, area).orderBy("y0").collect()
    assert [(b.y0, b.y1) for b in blocks] == [(10, 59), (80, 159)]
    boxes = spark.createDataFrame([(1, 0, 10, 10, 69, 59)], "image_id long, unit int, x0 int, y0 int, x1 int, y1 int")
    tone = slicing.colours(df, boxes).first()
    assert tone.chip >> 16 > 150 and slicing.crops(df, boxes).first().png[:4] == b"\x89PNG" and slicing.contact_sheets(df, boxes).count() == 1


def test_whole_pages(spark):
    """Adverts, neighbours without captions in one row, scraps that are part of a picture or its caption, pages of adverts."""
    from pagewright.operators import whole

    page = np.full((100, 100, 3), 255, np.uint8)
    page[5:45, 5:91] = np.random.default_rng(3).integers(0, 200, (40, 86, 3))
    box = lambda x0, y0, x1, y1: (x0, y0, x1, y1, [(y0, y1, x0, x1)])
    rows = [
        (1, 0, *box(5, 5, 90, 44)), (1, 1, 5, 50, 40, 90, [(50, 80, 5, 40), (84, 90, 9, 30)]), (1, 2, *box(50, 50, 90, 90)), (1, 3, *box(95, 52, 99, 88)), (2, 0, *box(5, 5, 90, 44)), (2, 1, *box(0, 50, 9, 69)),
        (3, 0, 10, 50, 60, 99, [(50, 90, 10, 60), (95, 99, 15, 40)]), (3, 1, *box(62, 60, 66, 65)), (3, 2, *box(80, 60, 90, 65)),
    ]
    slices = spark.createDataFrame(rows, "image_id long, unit int, x0 int, y0 int, x1 int, y1 int, parts array<struct<y0:int,y1:int,x0:int,x1:int>>")
    pages = spark.createDataFrame([(i, 100, 100, bytearray(page.tobytes())) for i in (1, 2, 3)], "image_id long, height int, width int, data binary")
    found = sorted(tuple(r) for r in whole.adapted(pages, slices).select("image_id", "role", "pos", "x0", "y0", "x1", "y1", F.array("cx0", "cy0", "cx1", "cy1")).collect())
    none = [None] * 4
    ad = ("ad", 0, 5, 5, 90, 44, none)
    assert found == [(1, *ad), (1, "unit", 0, 5, 50, 40, 80, [5, 84, 40, 90]), (1, "unit", 1, 50, 50, 99, 90, none), (2, *ad), (3, *ad), (3, "unit", 0, 10, 50, 66, 90, [15, 60, 90, 99])]


def test_headings_are_no_part_of_a_picture(spark):
    from pagewright.operators import whole

    parts = [(0, 9, 0, 99), (20, 79, 0, 99), (84, 93, 10, 60)]
    slices = spark.createDataFrame([(1, 0, parts), (1, 1, parts[1:]), (2, 0, parts[:2])], "image_id long, unit int, parts array<struct<y0:int,y1:int,x0:int,x1:int>>")
    found = {(r.image_id, r.unit): ([p.y0 for p in r.art], [p.y0 for p in r.caps]) for r in whole.split_parts(slices).collect()}
    assert found == {(1, 0): ([20], [84]), (1, 1): ([20], [84]), (2, 0): ([20], [0])}


def test_side_of_captions_against_plain_version(spark):
    """Inside, then at the ends, then between; the first that isn't even decides."""
    r = random.Random(8)
    pages = [[[(r.random() < 0.4, r.choice([-1, 0, 0, 1]), r.randrange(1, 9)) for _ in range(r.randrange(1, 6))] for _ in range(r.randrange(1, 4))] for _ in range(60)]
    rows, wanted = [], {}
    for k, cells in enumerate(pages):
        votes = [0, 0, 0]
        for j, groups in enumerate(cells):
            at, made = 0, []
            for pictured, inside, gap in groups:
                made.append((at + gap, at + gap + 5, pictured, inside))
                at = made[-1][1]
            for i, (y0, y1, pictured, inside) in enumerate(made):
                rows.append((k, 0, j, 0, i, y0, y1, int(pictured), inside if pictured else None))
                if pictured:
                    votes[0] += inside
                elif 0 < i < len(made) - 1:
                    up, down = y0 - made[i - 1][1], made[i + 1][0] - y1
                    votes[2] += (up < down) - (down < up)
                elif len(made) > 1:
                    votes[1] += 1 if i else -1
        wanted[k] = next((v > 0 for v in votes if v), True)
    keys = ["image_id", "section", "cell", "col"]
    found = slicing.caption_sides(spark.createDataFrame(rows, "image_id long, section int, cell int, col int, g int, y0 int, y1 int, pictured int, inside int"), keys)
    assert {x.image_id: x.captions_below for x in found.collect()} == wanted and len(set(wanted.values())) == 2


def test_low_bands_against_plain_version(spark):
    """The first band under 8 rows joins its nearer neighbour until none is left."""
    r = np.random.default_rng(11)
    rows, cells, wanted = [], [], {}
    for k in range(25):
        page, at, runs_of = np.full((260, 30, 3), 255, np.uint8), 3, []
        while at < 235:
            end = at + int(r.choice([2, 3, 5, 7, 12]))
            page[at:end] = r.integers(0, 200, (end - at, 30, 3))
            runs_of.append([at, end - 1])
            at = end + int(r.choice([2, 3, 4, 9]))
        rows.append((k, 260, 30, bytearray(page.tobytes())))
        cells.append((k, 0, 0, 0, 0, 29, 0, 259, 0xFFFFFF))
        while len(runs_of) > 1 and (low := [i for i, (a, b) in enumerate(runs_of) if b - a + 1 < 8]):
            i = low[0]
            up, down = (runs_of[i][0] - runs_of[i - 1][1] if i else 999), (runs_of[i + 1][0] - runs_of[i][1] if i + 1 < len(runs_of) else 999)
            j = i - 1 if up <= down else i + 1
            runs_of[j] = [min(runs_of[i][0], runs_of[j][0]), max(runs_of[i][1], runs_of[j][1])]
            del runs_of[i]
        wanted[k] = [tuple(x) for x in runs_of]
    images_ = spark.createDataFrame(rows, "image_id long, height int, width int, data binary")
    found = slicing.bands(images_, spark.createDataFrame(cells, "image_id long, section int, cell int, col int, x0 int, x1 int, y0 int, y1 int, colour int")).collect()
    assert {k: sorted((b.y0, b.y1) for b in found if b.image_id == k) for k in wanted} == wanted


def test_data_uri(spark):
    import base64

    from pagewright.functions import text as t

    body = bytes(range(200))
    got = spark.createDataFrame([("a.PNG", bytearray(body))], "p string, b binary").select(t.data_uri(F.col("p"), F.col("b")).alias("u")).first().u
    assert got == "data:image/png;base64," + base64.b64encode(body).decode()


def test_image_source_round_trip(spark, tmp_path):
    page = drawings.grid_picture(2)
    (tmp_path / "a.png").write_bytes(images.png(page))
    got = slicing.from_image_source(images.staged(spark, str(tmp_path)).select("image")).first()
    assert np.array_equal(np.frombuffer(got.data, np.uint8).reshape(page.shape), page)


def test_streams(spark, tmp_path):
    from pagewright.streaming import live

    spark.sql("select timestamp'2024-01-01 00:00:00' ts, 0 n_images, 0 n_captions, 1 n_options union all select timestamp'2024-01-01 00:01:00', 2, 0, 5").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = live.hold_counts(stream, "ts").writeStream.format("memory").queryName("held").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {(r.reason, r.n) for r in spark.table("held").collect()} == {("NO_BODY_IMAGE", 1), ("OPTION_UNMAPPABLE", 1)}
