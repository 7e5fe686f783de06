"""Zip archives as a data source: ``name string, content binary`` of their files.

Reading makes a partition for each archive.  Writing makes an archive for each partition, in a folder beside the wanted
one that gets its name when all tasks are done: a task that fails or is lost leaves no archive, and one that runs twice
leaves one.  Rows are streamed in both directions, so memory holds one file at a time.

Defined cases: an empty selection raises and leaves nothing, as does a folder that exists; a partition without rows makes
no archive; a name that was in the partition before gets ``~2``, ``~3`` and so on; null names and contents are empty.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from pagewright.operators.products import valid_code
from pagewright.sources.runs import export

SCHEMA = "name string, content binary"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, which driver and tasks must share, and the path on it."""
    if re.match(r"[a-z][a-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


@dataclass
class Archive(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    rows: int
    path: str = ""


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, path = place(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [Archive(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.lower().endswith(".zip")]

    def read(self, partition: Archive | None) -> Iterator[tuple]:
        if partition is None:
            return
        system, _ = place(self.path)
        with system.open_input_file(partition.path) as file, zipfile.ZipFile(file) as z:
            for entry in z.infolist():
                if not entry.is_dir():
                    yield entry.filename, z.read(entry)


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.beside = path.rstrip("/"), f"{path.rstrip('/')}._{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, folder = place(self.beside)
        first = next(iterator, None)
        if first is None:
            return Written(0)
        system.create_dir(folder, recursive=True)
        mine = f"{folder}/{uuid.uuid4().hex}"
        names: dict[str, int] = {}
        with system.open_output_stream(f"{mine}.open") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            row = first
            while row is not None:
                name = row["name"] or ""
                names[name] = times = names.get(name, 0) + 1
                stem, dot, suffix = name.rpartition(".")
                z.writestr(name if times == 1 else f"{stem}~{times}.{suffix}" if dot else f"{name}~{times}", bytes(row["content"] or b""))
                row = next(iterator, None)
        return Written(sum(names.values()), f"{mine}.open")

    def commit(self, messages: list) -> None:
        system, folder = place(self.beside)
        _, target = place(self.path)
        parts = sorted(m.path for m in messages if m is not None and m.rows)
        if not parts or system.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"no file is selected for {self.path}" if not parts else f"{self.path} exists")
        for k, part in enumerate(parts):
            system.move(part, f"{folder}/part-{k:05d}.zip")
        for other in system.get_file_info(fs.FileSelector(folder)):
            if other.path.endswith(".open"):  # of an attempt that was given up
                system.delete_file(other.path)
        system.move(folder, target)

    def abort(self, messages: list) -> None:
        system, folder = place(self.beside)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``name, content`` of all files in the archives below ``path``."""
    spark.dataSource.register(Archives)
    return spark.read.format("archives").load(path)


def save(files: DataFrame, path: str, archives: int | None = None) -> None:
    """Writes ``files (name, content)`` to ``path``, a new folder, in at most ``archives`` archives in order of the names
    (one for each partition of the session's shuffles unless stated)."""
    files.sparkSession.dataSource.register(Archives)
    wanted = files.select(F.coalesce("name", F.lit("")).alias("name"), "content")
    spread = wanted.repartitionByRange(archives, "name") if archives else wanted.repartitionByRange("name")
    spread.sortWithinPartitions("name").write.format("archives").mode("append").save(path)


def save_pages(pages: DataFrame, path: str, codes: DataFrame | None = None, archives: int | None = None) -> None:
    """The pages of the wanted codes as ``<code>.html``; a code that can't be a file's name gives way to ``page-`` and the
    hash of code and page."""
    stand_in = F.concat(F.lit("page-"), F.left(F.sha2(F.concat_ws("\n", "code", "html"), 256), F.lit(16)))
    name = F.concat(F.when(valid_code(F.col("code")), F.col("code")).otherwise(stand_in), F.lit(".html"))
    save(export(pages, codes).select(name.alias("name"), F.encode("html", "UTF-8").alias("content")), path, archives)


def save_crops(cut: DataFrame, path: str, archives: int | None = None) -> None:
    """The pictures of ``slicing.crops`` as ``<image_id>/<unit>.png``."""
    save(cut.select(F.concat_ws("/", "image_id", F.concat(F.col("unit"), F.lit(".png"))).alias("name"), F.col("png").alias("content")), path, archives)
