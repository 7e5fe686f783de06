"""What moves by a filter of ids, rows judged where they are read, and components of chains."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.lineage import Scratch
from pagewright.llm import decontam, lang_gru, near_dup
from pagewright.llm.common import BATCH_BYTES, BATCH_LIMIT, IdFilter, without_ids
from tests.conftest import DATA


def test_the_filter_lets_all_its_ids_through_and_few_others(spark):
    r = np.random.default_rng(1)
    ids = np.unique(r.integers(-(1 << 63), (1 << 63) - 1, 20_000))
    own = IdFilter.of(spark.createDataFrame([(int(i),) for i in ids] + [(None,)], "id long"))
    assert own.may_hold(pa.array(ids)).all()
    assert own.may_hold(pa.array(r.integers(0, 1 << 60, 200_000))).mean() < 0.001
    assert own.may_hold(pa.array([None, int(ids[0])], pa.int64())).tolist() == [False, True]
    assert not IdFilter.of(spark.createDataFrame([], "id long")).may_hold(pa.array([0, 1])).any()


def test_rows_of_rejected_ids_go_exactly(spark, monkeypatch):
    docs = spark.createDataFrame([(i if i % 9 else None, f"t{i}") for i in range(400)] + [(5, "twice")], "doc_id long, _id2 string")
    rejected = spark.createDataFrame([(i,) for i in range(0, 400, 3)] + [(5,), (5,), (None,)], "doc_id long")
    gone = {i for i in range(0, 400, 3)} | {5}
    want = sorted((repr(r.doc_id), r._id2) for r in docs.collect() if r.doc_id not in gone)
    left = lambda: sorted((repr(r.doc_id), r._id2) for r in without_ids(docs, rejected).collect())
    assert left() == want
    # a filter that lets everything through changes nothing but what is moved
    monkeypatch.setattr(IdFilter, "may_hold", lambda self, ids: np.ones(len(ids), bool))
    assert left() == want


def test_sets_are_right_whatever_the_filter_lets_through(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = sorted(near_dup.near_duplicates(docs).collect())
    monkeypatch.setattr(IdFilter, "may_hold", lambda self, ids: np.ones(len(ids), bool))
    assert sorted(near_dup.near_duplicates(docs).collect()) == first


def test_a_chain_in_order_takes_few_rounds(spark, monkeypatch):
    """Each round at least thins a chain out; by the ids themselves it would take a round for each."""
    kept, n = [], 600
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: kept.append(1) or keep(self, df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(10_000, 10_001)], "a long, b long")
    found = near_dup.components(edges, Scratch(spark)).collect()
    by = {}
    for r in found:
        by.setdefault(r.component, set()).add(r.id)
    assert sorted(map(len, by.values())) == [2, n + 1] and len(kept) < 40


def test_language_and_contamination_judge_rows_in_place(spark):
    """The rows that stay are those that the operators' own reports leave, with all columns, and nothing is joined."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit("own column"))
    model = lang_gru.fit(lang_gru.sample(docs))
    kept = lang_gru.known_language(docs, 0.5, model=model)
    assert kept.columns == docs.columns and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    report = lang_gru.identify(docs, model=model).where("lang_pred <> 'und' and score >= 0.5").select("doc_id")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in report.collect())
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    held = {r.doc_id for r in decontam.contamination(docs, items).collect()}
    clean = decontam.clean(docs, items)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - held
    assert "Exchange" not in clean._jdf.queryExecution().executedPlan().toString() and held


def test_many_slices_of_items_are_one_scan(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SLICE_BYTES", 300)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(20)]
    docs = [(i, " ".join(word() for _ in range(40)) + (" " + items[i][1] if i < 20 and i % 2 else "")) for i in range(60)] + [(None, None)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    clean = decontam.clean(a, b)
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ExistingRDD") + plan.count("LocalTableScan") == 1 and plan.count("MapInArrow") > 3
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs if i is None or i >= 20 or not i % 2}


def test_stages_are_deleted_once_read(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0
    path = rows.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    from pathlib import Path

    assert [p.name for p in Path(path).parents[1].iterdir()] == ["byte_bpe"]


def test_stages_hand_long_texts_to_python_in_small_batches(spark):
    """A batch isn't 10,000 rows of any length: an executor and its workers hold several of them."""

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    try:
        for stage in (corpus_pipeline.encoding, corpus_pipeline.decontamination):
            spark.conf.unset(BATCH_LIMIT)
            stage(spark, docs, DATA)
            sizes = [r.size for r in docs.mapInArrow(size, "size long").collect()]
            assert sum(sizes) > 30_000_000 and max(sizes) < BATCH_BYTES + 100_000
        spark.conf.set(BATCH_LIMIT, "1m")
        corpus_pipeline.encoding(spark, docs, DATA)
        assert spark.conf.get(BATCH_LIMIT) == "1m"
    finally:
        spark.conf.unset(BATCH_LIMIT)
