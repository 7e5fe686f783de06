"""Archives, the picture store, and breaks in buckets."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import breaks
from pagewright.plans import convert
from pagewright.sources import archives, fetch, images, runs


def test_archives_come_back(spark, tmp_path):
    rows = [(f"c{k}", f"<p>{k}\r\n</p>") for k in range(200)] + [("c7", "again"), ("../x", "kept"), (None, "nameless")]
    pages = spark.createDataFrame(rows, "code string, html string")
    archives.save_pages(pages, str(tmp_path / "all"), archives=3)
    assert len(list((tmp_path / "all").glob("part-*.zip"))) == 3 and [x.name for x in tmp_path.iterdir()] == ["all"]
    found = {r.name: bytes(r.content).decode() for r in archives.read(spark, str(tmp_path / "all")).collect()}
    assert len(found) == len(rows) and found["c3.html"] == "<p>3\r\n</p>"
    assert {found["c7.html"], found["c7~2.html"]} == {"<p>7\r\n</p>", "again"} and sum(n.startswith("page-") for n in found) == 2
    back = {r.code: r.html for r in runs.pages_in_zips(spark, str(tmp_path / "all")).collect()}
    assert back == {n[:-5]: h for n, h in found.items()}
    archives.save_pages(pages, str(tmp_path / "some"), spark.createDataFrame([("c1",), (" ",), ("c1",), ("gone",)], "code string"))
    assert [r.name for r in archives.read(spark, str(tmp_path / "some")).collect()] == ["c1.html"]


def test_nothing_is_left_of_failed_archives(spark, tmp_path):
    pages = spark.createDataFrame([(f"c{k}", "x") for k in range(50)], "code string, html string")
    with pytest.raises(Exception, match="no file is selected"):
        archives.save_pages(pages, str(tmp_path / "none"), spark.createDataFrame([("other",)], "code string"))
    bad = pages.withColumn("html", F.when(F.col("code") == "c49", F.raise_error(F.lit("lost task"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="lost task"):
        archives.save(bad.select(F.col("code").alias("name"), F.encode("html", "UTF-8").alias("content")), str(tmp_path / "bad"), 4)
    assert list(tmp_path.iterdir()) == []
    archives.save_pages(pages, str(tmp_path / "once"))
    with pytest.raises(Exception, match="exists"):
        archives.save_pages(pages, str(tmp_path / "once"))
    assert archives.read(spark, str(tmp_path / "once")).count() == 50 and len(list(tmp_path.iterdir())) == 1


def test_crops_in_archives(spark, tmp_path):
    cut = spark.createDataFrame([(1, 0, b"a"), (1, 1, b"b"), (2, 0, None)], "image_id long, unit int, png binary")
    archives.save_crops(cut, str(tmp_path / "crops"), archives=2)
    assert {r.name: bytes(r.content) for r in archives.read(spark, str(tmp_path / "crops")).collect()} == {"1/0.png": b"a", "1/1.png": b"b", "2/0.png": b""}


def fetcher(log: str):
    """Says a picture for most URLs; writes down every call."""

    def get(url: str) -> bytes:
        with open(log, "a") as f:
            f.write(url + "\n")
        calls = open(log).read().split("\n").count(url)
        if "always" in url or "twice" in url and calls < 3:
            raise OSError("no answer")
        if "blank" in url:
            return b""
        if "text" in url:
            return b"no picture"
        return images.png(np.full((len(url), 40, 3), (10, 20, 30), np.uint8))

    return get


def test_picture_store(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    urls = [f"https://shop.example/{x}.png" for x in ("a", "bb", "twice", "always", "blank", "text")]
    asked = spark.createDataFrame([(u,) for u in urls * 3] + [(None,), ("",)], "url string")
    report = fetch.fill(asked, store, fetcher(log), tasks=4, wait=0.01)
    told = {r.url.rsplit("/", 1)[1]: (r.tries, r.error) for r in report.collect()}
    assert told == {"a.png": (1, None), "bb.png": (1, None), "twice.png": (3, None), "text.png": (1, None), "always.png": (3, "OSError: no answer"), "blank.png": (3, "ValueError: no bytes")}
    assert [(r.error, r.n_urls) for r in fetch.failures(report).collect()] == [("OSError: no answer", 1), ("ValueError: no bytes", 1)]
    calls = Counter(open(log).read().split())
    assert calls == dict(zip(urls, (1, 1, 3, 3, 3, 1), strict=True))
    again = fetch.fill(asked, store, fetcher(log), tasks=4, wait=0.01)
    assert {r.url for r in again.collect()} == {urls[3], urls[4]} and Counter(open(log).read().split())[urls[0]] == 1
    size = {r.url: (r.width, r.height) for r in fetch.sizes(asked, store).collect()}
    assert size == {u: (40, len(u)) for u in urls[:3]}
    pixels = {r.url: r for r in fetch.pictures(asked, store).collect()}
    assert set(pixels) == set(urls[:3]) and bytes(pixels[urls[0]].data[:3]) == bytes([10, 20, 30]) and pixels[urls[1]].height == len(urls[1])


def test_store_feeds_the_batch(spark, tmp_path):
    store, body = str(tmp_path / "store"), "".join(f'<p>A long enough caption number {k}.</p><img src="/{x}.png">' for k, x in enumerate(["a", "always", "b"]))
    rows = spark.createDataFrame([("c1", "n", "b", "k", body, [])], "code string, name string, brand string, category string, body string, options array<struct<name:string,values:array<string>,numbers:array<string>>>")
    urls = spark.createDataFrame([(f"https://shop.example/{x}.png",) for x in ("a", "always", "b")], "url string")
    fetch.fill(urls, store, fetcher(str(tmp_path / "log")), tasks=2, wait=0.01)
    made = convert.convert(rows, fetch.sizes(urls, store), base="https://shop.example/").collect()[0]
    shown = {p.url for p in list(made.ads) + list(made.units)}
    assert shown == {"https://shop.example/a.png", "https://shop.example/b.png"} and not made.verdict.ok and "always" in str(made.verdict)


@pytest.mark.parametrize("seed", range(3))
def test_buckets_change_nothing(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(60)]), k, rng.choice(["x", "x", "y", None])) for k in range(300)]
    events = spark.createDataFrame(rows, "u long, at long, id long, kind string")
    order, day, few = ["at", "id"], F.floor(F.col("at") / 7), F.floor(F.col("gap") / 2)
    same = lambda a, b: Counter(a.collect()) == Counter(b.select(a.columns).collect())
    one, many = breaks.with_gaps(events, ["u"], order, F.col("at")), breaks.with_gaps(events, ["u"], order, F.col("at"), bucket=day)
    assert same(one, many)
    last = {}
    for u, at, k, _ in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2])):
        last.setdefault(u, []).append((k, None if at is None or not last.get(u) or last[u][-1][2] is None else at - last[u][-1][2], at))
    assert {r.id: r.gap for r in many.collect()} == {k: gap for found in last.values() for k, gap, _ in found}
    assert same(breaks.natural_breaks(one, ["u"]), breaks.natural_breaks(one, ["u"], bucket=few))
    assert same(breaks.group_by_breaks(one, ["u"], order), breaks.group_by_breaks(one, ["u"], order, bucket=day, gap_bucket=few))
    assert breaks.group_by_breaks(one, ["u"], order, bucket=day).count() == len(rows)
    assert same(breaks.value_runs(events, ["u"], ["id"], "kind", "id"), breaks.value_runs(events, ["u"], ["id"], "kind", "id", F.floor(F.col("id") / 10)))
