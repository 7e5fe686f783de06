"""Work that grows with rows or pixels: dealt over tasks, and no pixels shuffled."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.lineage import checkpointed
from pagewright.operators import render
from pagewright.plans import drawings
from pagewright.plans import queries as q
from pagewright.plans.tables import spread
from pagewright.slicer import slicing
from pagewright.sources import xlsx
from tests.conftest import DATA


def plan_of(df) -> list[str]:
    return [re.sub(r"^[\s:+\-|]+", "", x) for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if x]


def test_tasks_grow_with_rows(spark):
    rows = spark.range(0, 1000, 1, 1).withColumnRenamed("id", "k")
    assert spread(rows, "k", 100).rdd.getNumPartitions() == 10
    assert spread(rows, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(rows.limit(0), "k").count() == 0 and sorted(r.k for r in spread(rows, "k", 100).collect()) == list(range(1000))


@pytest.mark.parametrize("name", ["page_parts", "rendered_pages", "product_bodies", "converted_products"])
def test_nothing_is_made_of_rows_before_they_are_dealt(spark, name):
    plan = plan_of(q.queries()[name](spark, DATA))
    at = next(i for i, line in enumerate(plan) if line.startswith("RepartitionByExpression"))
    end = next(i for i in range(at, len(plan)) if plan[i].startswith("Relation"))
    assert all(line.startswith("Project [p_partkey") for line in plan[at + 1 : end])


def test_pages_are_written_without_a_shuffle_of_their_parts(spark):
    assert not [x for x in plan_of(render.pages(q._parts_as_products(spark, DATA))) if x.startswith(("Aggregate", "Join"))]


def test_handles_give_what_stored_pixels_give(spark):
    keys = spark.createDataFrame([(i, i) for i in range(6)], "k long, n int")
    handles = drawings.drawn(keys)
    drawn = [(r.image_id, r.height, r.width, handles.read(r.asDict())) for r in handles.rows.collect()]
    assert all(p.shape == (h, w, 3) for _, h, w, p in drawn)
    stored = spark.createDataFrame([(i, h, w, bytearray(p.tobytes())) for i, h, w, p in drawn], "image_id long, height int, width int, data binary")
    rows = lambda images: sorted(map(repr, slicing.units(images).collect()))
    assert rows(handles) == rows(stored)
    laid = slicing.by_id(handles)
    assert "data" not in laid.rows.columns and slicing.by_id(laid) is laid


@pytest.mark.parametrize("sent", [200_000, 0])
def test_workbooks_take_their_columns_from_a_table_that_is_ready(spark, monkeypatch, sent):
    """Cells meet the columns without a shuffle of their own while the columns are few; both ways give the same rows."""
    monkeypatch.setattr(xlsx, "SENT", sent)
    grid = [["상품코드", "상품명", "상세설명", "옵션1", "옵션2"], ["1", "a", "x", "size=S,L", "hue=1. red"], ["", "", "y", "k=v", ""], ["2", "b", "", "", "z"]]
    cells = [(f"b{n}", i, j, v) for n in range(3) for i, line in enumerate(grid) for j, v in enumerate(line) if v]
    found = xlsx.products(spark.createDataFrame(cells, "path string, row int, col int, value string"))
    assert sum(line.startswith("Join") for line in plan_of(found)) == 1
    assert ("strategy=broadcast" in "".join(plan_of(found))) == (sent > 0)
    rows = sorted((r.path, r.code, r.body, [(o.name, list(o["values"])) for o in r.options]) for r in found.collect())
    assert rows == sorted((f"b{n}", *x) for n in range(3) for x in [("1", "x", [("size", ["S", "L"]), ("hue", ["red"])]), ("2", "", [("", ["z"])])])


@pytest.mark.parametrize("sent", [200_000, 0])
def test_cells_are_not_sent_through_the_driver(spark, monkeypatch, sent):
    """Cells of many books, made of a table of a few bytes: the planner guesses them small, so nothing may be sent by its guess."""
    steps = []
    monkeypatch.setattr(xlsx, "SENT", sent)
    monkeypatch.setattr(xlsx, "checkpointed", lambda df: steps.append(df) or checkpointed(df))
    lines = [["report"], ["상품코드", "상품명", "상세설명", "옵션1", "옵션1"], *([f"{i}", f"n{i}", "b" * 50, "size=S,L", "hue=red"] for i in range(30))]

    def write(batches):
        for batch in batches:
            for n in batch.column(0).to_pylist():
                path, row, col, value = zip(*((f"b{n}", i, j, v) for i, line in enumerate(lines) for j, v in enumerate(line)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(value)], names=["path", "row", "col", "value"])

    found = xlsx.products(spark.range(0, 20, 1, 2).mapInArrow(write, "path string, row int, col int, value string"))
    planned = [step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1] for step in [*steps, found]]
    assert [x.count("BroadcastExchange") for x in planned] == ["".join(plan_of(step)).count("strategy=broadcast") for step in [*steps, found]]
    marks = steps[1]
    assert "WindowGroupLimit" in planned[1]
    assert sorted(tuple(r) for r in marks.where("path = 'b7'").collect() if r.field) == [("b7", 1, "body", 2), ("b7", 1, "code", 0), ("b7", 1, "name", 1)]
    assert sorted(r.col for r in marks.where("path = 'b7' and field is null").collect()) == [3, 4]
    rows = sorted((r.path, r.code, r.name, [(o.name, list(o["values"])) for o in r.options]) for r in found.collect())
    assert rows == sorted((f"b{n}", f"{i}", f"n{i}", [("size", ["S", "L"]), ("hue", ["red"])]) for n in range(20) for i in range(30))


def test_pictures_are_read_by_their_tasks_where_a_shuffle_has_as_many_partitions(spark):
    images = slicing.by_id(drawings.drawn(spark.range(0, 400, 1, 4).selectExpr("id", "cast(id % 25 as int) n")))
    assert images.tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = images.rows.select("image_id", "height").groupBy("image_id").agg(F.collect_list("height").alias("items"))
    looked = slicing.beside(images, items.hint("merge")).mapInArrow(lambda batches: (b.select(["image_id"]) for b in batches), "image_id long")
    assert looked.rdd.getNumPartitions() == images.tasks and looked.count() == 400
