"""A store of pictures that is filled once for each distinct URL.

A picture lies in the store under ``images.cache_key`` of its URL, put there by a rename, so that no reader sees half of
one.  ``fill`` fetches only what the store lacks, in a bounded number of tasks, as the other side's servers are the limit;
a task that is lost and run again finds what it had put there and fetches the rest.

Defined cases: null and empty URLs are no pictures; a URL that occurs often is fetched once; an answer without bytes is a
failure; a failure is a row of the report and leaves no file, so the next ``fill`` tries it again; a file that is no
picture is left out by ``pictures`` and ``sizes``, and ``convert`` reports it as missing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.lineage import checkpointed
from pagewright.slicer import slicing
from pagewright.sources import images
from pagewright.sources.archives import place

TRIES = 3  # fixed value
WAIT = 1.5  # fixed value: seconds before the second try, twice as many before the third
REPORT = "url string, file string, tries int, error string"


def keyed(urls: DataFrame) -> DataFrame:
    """``url, file`` of the distinct URLs."""
    return urls.where(F.col("url") != "").select("url").distinct().withColumn("file", images.cache_key(F.col("url")))


def present(spark: SparkSession, store: str) -> DataFrame:
    """``file`` of what the store holds; contents aren't read."""
    system, path = place(store)
    system.create_dir(path, recursive=True)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))


def fill(urls: DataFrame, store: str, fetch: Callable[[str], bytes], tasks: int = 32, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """Fetches what ``urls (url)`` name and the store lacks; ``url, file, tries, error`` of each URL asked for (error: null
    if the picture is in the store now).  ``fetch`` gets a URL and returns bytes or raises; waits grow by ``wait`` a try."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = place(store)
        for batch in batches:
            for url, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                used, error = 0, None
                if system.get_file_info(f"{folder}/{file}").type == fs.FileType.NotFound:
                    used, error = _one(system, folder, url, file, fetch, tries, wait)
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([file]), pa.array([used], pa.int32()), pa.array([error], pa.string())], names=["url", "file", "tries", "error"])

    spark = urls.sparkSession
    lacking = keyed(urls).join(present(spark, store), "file", "left_anti").select("url", "file")
    return checkpointed(lacking.repartition(tasks, "url").mapInArrow(run, REPORT))


def _one(system: fs.FileSystem, folder: str, url: str, file: str, fetch: Callable[[str], bytes], tries: int, wait: float) -> tuple[int, str | None]:
    error = ""
    for k in range(1, tries + 1):
        try:
            content = fetch(url)
            if not content:
                raise ValueError("no bytes")
        except Exception as problem:  # whatever the fetcher raises is told in the report
            error = f"{type(problem).__name__}: {problem}"
            if k < tries:
                time.sleep(wait * k)
            continue
        half = f"{folder}/_{uuid.uuid4().hex}"  # names that begin so are hidden from Spark's sources
        with system.open_output_stream(half) as out:
            out.write(content)
        system.move(half, f"{folder}/{file}")
        return k, None
    return tries, error


def failures(report: DataFrame) -> DataFrame:
    """``error, n_urls``: how many URLs failed in the same way, the most frequent first."""
    return report.where(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("n_urls")).orderBy(F.desc("n_urls"), "error")


def sizes(urls: DataFrame, store: str) -> DataFrame:
    """``url, width, height`` of the pictures in the store, as ``convert`` takes them."""
    found = images.staged(urls.sparkSession, store).select("file", "image.width", "image.height")
    return keyed(urls).join(found, "file").select("url", "width", "height")


def pictures(urls: DataFrame, store: str) -> DataFrame:
    """``url, image_id, height, width, data`` of the pictures in the store, as ``convert`` takes them."""
    found = keyed(urls).join(images.staged(urls.sparkSession, store), "file")
    ids = found.select("url", F.xxhash64("image.origin").alias("image_id"))
    return slicing.from_image_source(found.dropDuplicates(["file"]).select("image")).join(ids, "image_id").select("url", "image_id", "height", "width", "data")
