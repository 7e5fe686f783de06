"""Runs of rendered pages: from folders of HTML files, zip archives or saved skeletons; and their sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.diff import outline
from pagewright.operators.products import valid_code


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """``code, html`` of the ``*.html`` files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("code"), F.decode("content", "UTF-8").alias("html"))


def pages_in_zips(spark: SparkSession, path: str) -> DataFrame:
    """``code, html`` of the pages in zip archives; an archive is read in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith(".html")):
                        yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1][:-5]]), pa.array([z.read(name).decode("utf-8", "replace")])], names=["code", "html"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("content").mapInArrow(run, "code string, html string")


def shapes(pages: DataFrame) -> DataFrame:
    return pages.select("code", outline(F.col("html")).alias("shape"))


def save_shapes(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").json(path)


def read_shapes(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)


def save_pages(pages: DataFrame, path: str) -> None:
    """One text file for each code, below ``code=...``; line ends are as in the page.  A code that can't be a file's name
    gives way to ``page-`` and the hash of code and page, so no page is lost."""
    stand_in = F.concat(F.lit("page-"), F.left(F.sha2(F.concat_ws("\n", "code", "html"), 256), F.lit(16)))
    pages.select(F.when(valid_code(F.col("code")), F.col("code")).otherwise(stand_in).alias("code"), F.col("html").alias("value")).write.mode("overwrite").partitionBy("code").option("lineSep", "\n").text(path)


def made(spark: SparkSession, path: str) -> DataFrame:
    """``code, modified`` of saved pages, the newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"code=([^/]+)/", 1).alias("code"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "code")


def export(pages: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Pages of the wanted codes (all without a list; blanks ignored), by code."""
    out = pages if codes is None else pages.join(codes.where(F.trim("code") != "").select("code").distinct(), "code", "left_semi")
    return out.orderBy("code")
