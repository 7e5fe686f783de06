"""Workbooks as DataFrames: the cells of the first sheet are read in the tasks, all else is windows, joins and grouping."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.text import bind, norm_header, parse_option, strip
from pagewright.lineage import checkpointed

# The header texts by which a field is found, the earlier first.
FIELDS = {
    "code": ["상품번호", "상품코드", "goodsno", "품번"],
    "name": ["상품명", "제품명", "goodsnm"],
    "brand": ["브랜드", "제조사", "brand"],
    "maker": ["거래처", "공급사", "제조사명"],
    "price": ["판매가", "판매가격", "price"],
    "cost": ["원가", "정가", "소비자가"],
    "category": ["카테고리", "분류"],
    "thumb": ["대표이미지url", "대표이미지", "목록이미지url", "목록이미지"],
    "body": ["상세설명", "상세정보", "상품상세", "detail"],
    "url": ["상품url", "상품링크"],
}
OPTIONS = ["옵션1", "옵션2", "옵션3", "옵션"]
REQUIRED = ["code", "name", "body"]
HEADER_ROWS = 10
SENT = 200_000  # columns of workbooks that are sent to all tasks; more are joined
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def sheet_cells(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the non-empty cells of the first sheet, from 0; the number 0 and false are empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}sheets/{_NS}sheet")
        relations = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = relations[first.get(_REL)].lstrip("/")
        shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as sheet:
            row, column = -1, -1
            for event, node in ElementTree.iterparse(sheet, ("start", "end")):
                if event == "start" and node.tag == f"{_NS}row":
                    row, column = int(node.get("r", row + 2)) - 1, -1
                elif event == "end" and node.tag == f"{_NS}c":
                    column += 1
                    if ref := re.match(r"[A-Z]+", node.get("r", "")):
                        column = -1
                        for letter in ref.group():
                            column = (column + 1) * 26 + ord(letter) - 65
                    kind, value = node.get("t", "n"), node.findtext(f"{_NS}v") or ""
                    if kind == "inlineStr":
                        value = _text(node)
                    elif kind == "s":
                        value = shared[int(value)] if value else ""
                    elif kind in ("n", "b") and value and float(value) == 0:
                        value = ""
                    if value.strip():
                        yield row, column, value.strip()
                elif event == "end" and node.tag == f"{_NS}row":
                    node.clear()


def cells(books: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``path, row, col, value`` of workbooks given as bytes; an empty workbook fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(sheet_cells(content))
                if not found:
                    raise ValueError(f"no cells in the first sheet of {path}")
                rows, columns, values = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(values)], names=["path", "row", "col", "value"])

    return books.select(path_col, content_col).mapInArrow(run, "path string, row int, col int, value string")


def _candidates(spark: SparkSession) -> DataFrame:
    rows = [(field, i, name) for field, names in FIELDS.items() for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "field string, priority int, name string").select("field", "priority", norm_header(F.col("name")).alias("header"))


def header_marks(found: DataFrame) -> DataFrame:
    """``path, header_row, field, col``: what ``header_columns`` gives, and a row without a field for each column of options.

    The cells meet no other table here: their size is guessed from the table that they are made of, however small that is,
    so that a join by size could send all of them through the driver."""
    nth = F.dense_rank().over(Window.partitionBy("path").orderBy("row"))
    first = found.withColumn("nth", nth).where(F.col("nth") <= HEADER_ROWS)  # limited in the tasks before the cells move
    texts = first.groupBy("path", "row", norm_header(F.col("value")).alias("header")).agg(F.max("col").alias("col"), F.collect_set("col").alias("cols"))
    known = texts.join(F.broadcast(_candidates(found.sparkSession)), "header", "left")
    axes = F.flatten(F.collect_list(F.when(F.col("header").isin(OPTIONS), F.col("cols"))))
    per = known.groupBy("path", "row", "field").agg(F.min_by("col", "priority").alias("col"), axes.alias("axes"))
    mark = lambda field, col: F.struct(field.cast("string").alias("field"), col.alias("col"))
    marks = F.when(F.col("field").isNull(), F.transform("axes", lambda col: mark(F.lit(None), col))).otherwise(F.array(mark(F.col("field"), F.col("col"))))
    rows = per.groupBy("path", "row").agg(F.count("field").alias("hits"), F.flatten(F.collect_list(marks)).alias("marks"))
    best = rows.groupBy("path").agg(F.max_by(F.struct("hits", "row", "marks"), F.struct("hits", -F.col("row"))).alias("best")).where("best.hits > 0")
    return best.select("path", F.col("best.row").alias("header_row"), F.inline("best.marks"))


def header_columns(found: DataFrame) -> DataFrame:
    """``path, header_row, field, col``: of the first ten non-empty rows the one with most known fields (the earliest on
    a tie); of equal headers the last column; of several headers of a field the first candidate."""
    return header_marks(found).where("field is not null")


def missing_fields(found: DataFrame, columns: DataFrame) -> DataFrame:
    """``path, field`` of required fields that a workbook lacks."""
    wanted = found.select("path").distinct().select("path", F.explode(F.array(*map(F.lit, REQUIRED))).alias("field"))
    return wanted.join(columns, ["path", "field"], "left_anti")


def products(found: DataFrame) -> DataFrame:
    """A row for each product with a code or a name: ``path, row``, the fields as strings and ``options``."""
    found = checkpointed(found)  # read several times below
    # small, and ready before the cells are read: a broadcast that is planned while they are waits for all their tasks
    marks = checkpointed(header_marks(found))
    # beyond the limit neither side may be sent, whatever size the planner guesses
    body = found.join(F.broadcast(marks) if marks.count() <= SENT else marks.hint("merge"), ["path", "col"]).where("row > header_row")
    c = F.col
    axis = F.when(c("field").isNull(), bind(parse_option(c("value")), lambda a: F.when(a.isNotNull(), F.struct(c("col").alias("col"), a.alias("axis")))))
    fields = [F.coalesce(F.max(F.when(c("field") == f, strip(c("value")))), F.lit("")).alias(f) for f in FIELDS]
    rows = body.withColumn("axis", axis).groupBy("path", "row").agg(*fields, F.array_sort(F.collect_list("axis")).alias("axes"))
    return rows.select("path", "row", *FIELDS, F.transform("axes", lambda a: a["axis"]).alias("options")).where("code <> '' or name <> ''")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Products of all workbooks at a path."""
    return products(cells(spark.read.format("binaryFile").load(path)))
