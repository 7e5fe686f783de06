"""Cutting the lineage of results that several later steps read, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a session that runs in one process gets a temporary
    folder, as in tests; a cluster gets an error, as its machines would not see each other's folders."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A copy in the shared folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables of one job, written below the shared folder and deleted when no later step reads them.

    A written table survives lost executors like a checkpoint; besides it is columnar and has a known size, by which the
    optimizer chooses its joins.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.top = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self._held: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self._held)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self._held[id(stored)] = stored, path
        return stored

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of ``keep``; others are ignored."""
        for table in tables:
            if id(table) in self._held:
                remove(self.spark, self._held.pop(id(table))[1])


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
