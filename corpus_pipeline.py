"""A corpus in five stages, each written as Parquet and read again as the next one's documents.

Quality rules remove lines that at least ``line_rules.LINE_DOCS`` distinct documents hold, near copies counted once, and
reject failing documents; language ID rejects documents without a
recognisable language; one document of each near-duplicate group stays; documents that hold a benchmark item go; what
is left is encoded.  All stages but the last return the columns of ``documents``.

Defined cases: a null text fails the rules; rows with one id are one document to the near-duplicates' stage, which
rejects by id, and a row without an id cannot be rejected by it; columns beyond those of
``documents`` are handed on up to the last stage; empty tables give empty results.

Each stage has the session hand its rows to Python in batches of bounded bytes; ``run`` puts the session's own limit back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.lineage import Scratch, remove, shared_folder
from pagewright.llm import byte_bpe, decontam, lang_gru, line_rules, near_dup
from pagewright.llm.common import BATCH_LIMIT, small_batches, without_ids

MIN_LANGUAGE_SCORE = 0.5
NEAR_PERCENT = 80  # of the union of two documents' shingles of five words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # other columns travel inside a struct, so their names can't meet those of the rule counts
    packed = docs.select("text", "source", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    judged = line_rules.apply_line_rules(packed, **line_rules.LIMITS).where("kept")
    values = {"text": F.col("clean_text"), "n_chars": F.when(F.col("n_removed_lines") > 0, F.length("clean_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return judged.select(*(values.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lang_gru.known_language(docs, MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    judged = near_dup.near_duplicates(docs, percent=NEAR_PERCENT)
    return without_ids(docs, Scratch(spark).keep(judged.where("not kept").select("doc_id").distinct()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]
ORACLE_SQL = None  # the language model is not expressible in SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the stages' tables lie below ``spark.checkpoint.dir``, and each is deleted once the next
    one is written."""
    top, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs, limit = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH_LIMIT, None)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
            docs = spark.read.parquet(f"{top}/{name}")
            if before:
                remove(spark, before)
            before = f"{top}/{name}"
    finally:
        if limit is None:
            spark.conf.unset(BATCH_LIMIT)
    return docs
