"""Pictures: a lookup of staged files by the hash of their URL, widths, and PNG bytes for fixtures and crops."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(url: Column) -> Column:
    """Name of the staged file of a URL: its SHA-1 and a suffix of at most five characters."""
    suffix = F.left(F.lower(F.regexp_extract(url, r"(\.[A-Za-z0-9]+)(?:[?#].*)?$", 1)), F.lit(5))
    return F.concat(F.sha1(F.encode(url, "UTF-8")), F.when(suffix != "", suffix).otherwise(".jpg"))


def staged(spark: SparkSession, path: str) -> DataFrame:
    """``file, image`` of staged pictures (Spark's image source: BGR bytes by rows)."""
    found = spark.read.format("image").option("dropInvalid", "true").load(path)
    return found.select(F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("file"), "image")


def attach(pieces: DataFrame, pictures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces (url) with their pictures, and the pieces whose picture is missing, which must be reported."""
    keyed = pieces.withColumn("file", cache_key(F.col("url")))
    return keyed.join(pictures, "file"), keyed.join(pictures, "file", "left_anti")


def natural_width(image: Column) -> Column:
    return F.coalesce(image["width"], F.lit(0))


def png(pixels: np.ndarray) -> bytes:
    """An RGB array (height, width, 3) as PNG."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
