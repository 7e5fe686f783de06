"""Filter audit, hard negatives and shards against plain versions and SQL."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import filter_audit, hard_negatives, queries, sharding
from tests.conftest import DATA, same_as_sql


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_hard_negatives"])
def test_queries_against_sql(spark, name):
    same_as_sql(spark, queries.queries()[name], queries.oracle_sql()[name])


# -- filter audit


def _plain_audit(docs, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = word.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i,
        }
        mine = [x for x in labels if i is not None and x[0] == i]
        rows.append((lang or "", {f for f, x in fails.items() if x}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, removed = {}, Counter()
    for part, order in itertools.product({r[0] for r in rows}, itertools.permutations("ABCDE")):
        left, gone = [r for r in rows if r[0] == part], []
        for step, f in enumerate(order, 1):
            now = [r for r in left if f in r[1]]
            redundant, left = sum(f in r[1] for r in gone), [r for r in left if f not in r[1]]
            gone += now
            removed[part, f] += len(now)
            lone = sum(r[1] == {f} for r in rows if r[0] == part)
            out[part, "".join(order), step] = [len(left), len(now), redundant, lone, sum(r[2] for r in now), sum(r[3] for r in now)]
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_applying_the_filters(spark):
    r = random.Random(1)
    texts = [None, "", " \t\n", "short", "SHOUT " * 120, " ".join(f"w{k}" for k in range(150)), " ".join(f"w{k}" for k in range(150)) + " # x",
             "ÉÀ\x1c\x85 ​" * 40, " ".join(f"long{k}" for k in range(30_000)), "a|b", "ABCDEFGHIJ" + "é" * 90, "ABCDEFGHIJ" + "é" * 89]
    docs = [(i if i % 17 else None, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(500 + i, texts[5], "en") for i in range(200)] + [(500, texts[5], "de"), (500, texts[5], "en"), (3, "other text of id 3", "en"), (None, None, None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 800, 3), 6, 6, 500, None]]
    a = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, part string").repartition(7)
    b = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in filter_audit.audit(a, b).collect()}
    assert got == _plain_audit(docs, labels)
    assert len(got) == 3 * 120 * 5
    assert filter_audit.audit(a.limit(0), b).count() == 0
    assert {x.good_lost + x.toxic_lost for x in filter_audit.audit(a, b.limit(0)).collect()} == {0}


def test_table_of_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for mask, (k, order) in itertools.product(range(32), enumerate(filter_audit.ORDERS)):
        hits = [i for i, f in enumerate(order) if mask >> "ABCDE".index(f) & 1]
        assert table[mask, k] == (hits[0] if hits else 5)


def test_tasks_hand_on_arrays_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "_PARTS", 2)
    docs = spark.createDataFrame([(i, f"text {i % 5} #", f"l{i % 9}") for i in range(90)], "doc_id long, text string, lang string")
    rows = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EDCBA' AND step = 1").collect()
    assert len(rows) == 9 and sum(x.removed for x in rows) == 85 and sum(x.kept for x in rows) == 5


# -- hard negatives


def _plain_negatives(vectors, step=100):
    rows = []
    for i, v, label in vectors:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        rows.append((i, [int(np.floor(256 * float(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    cut = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    dot = lambda a, b: cut(sum(x * y for x, y in zip(a, b, strict=False)))
    anchors = {}
    for i, v, label in rows:
        if i % step == 0:
            anchors[i] = min((label, v), anchors.get(i, (label, v)))
    out = set()
    for a, (label, v) in anchors.items():
        others = sorted((-dot(v, w), i, k) for i, w, k in rows if i != a)
        for s, p, _ in [x for x in others if x[2] == label][:5]:
            inside = [(n, t) for t, n, k in others if k != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out |= {(a, p, rank, n, -s, -t) for rank, (n, t) in enumerate(inside, 1)}
    return out


def _negatives(spark, vectors, **options):
    df = spark.createDataFrame([(*v, 7) for v in vectors], "vec_id long, embedding array<double>, label int, score int").repartition(5)
    rows = hard_negatives.hard_negatives(df, **options).collect()
    assert len(set(rows)) == len(rows)
    return {(x.anchor_id, x.positive_id, x.rank, x.negative_id, x.positive_score, x.negative_score) for x in rows}


def test_negatives_equal_a_plain_search(spark):
    r = random.Random(2)
    vectors = [(i, [r.gauss(0, 1) + (i % 4 == k) for k in range(4)], r.choice([0, 1, 2, 9])) for i in range(900)]
    vectors += [(None, [1.0] * 4, 1), (1001, None, 1), (1002, [1.0, None, 0.0, 0.0], 1), (1003, [float("nan")] * 4, 1), (1004, [float("inf")] * 4, 1), (1005, [1.0] * 4, None)]
    vectors += [(1100, [], 1), (1101, [2.0], 1), (1200, [2.0, 1.0], 1), (300, [0.5] * 4, 2), (300, [0.4] * 4, 2), (-100, [1.0, 0.0, 0.0, 1.0], 2), (42, [1.0] * 4, 3), (42, [1.0] * 4, 3)]
    want = _plain_negatives(vectors)
    assert _negatives(spark, vectors) == want and len(want) > 100
    assert _negatives(spark, vectors, slice_=3) == want


def test_equal_vectors_are_told_apart_by_their_ids(spark):
    """Thousands of equal rows on the border of a choice: their ids are refined, not the rows gathered."""
    vectors = [(100, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (200, [0.0, 1.0], 2), (201, [0.0, 1.0], 2)]
    vectors += [(10_000_000_000 - 101 * i, [0.5, 0.75], 3) for i in range(3000)] + [(5_000 + i, [0.6, 0.1], 4) for i in range(4)]
    got = _negatives(spark, vectors)
    assert got == _plain_negatives(vectors)
    assert len({x[3] for x in got if x[0] == 100}) == 10


def test_scores_of_any_size(spark):
    vectors = [(0, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [3.0, 5.0], 1), (3, [0.5e-30, 3.0], 2), (4, [1e16, 1.0], 2), (100, [2.0**40, 3.0], 1), (101, [2.0**40, 1.0], 1), (102, [2.0**39, 5.0], 2)]
    assert _negatives(spark, vectors) == _plain_negatives(vectors)


def test_negatives_of_nothing(spark):
    assert _negatives(spark, []) == set()
    assert _negatives(spark, [(5, [1.0], 1)]) == set()
    assert _negatives(spark, [(0, [1.0], 1), (3, [1.0], 2)]) == set()


def test_a_round_keeps_few_rows_for_each_window(spark, monkeypatch):
    """What is gathered is bounded by k and the slack, however many rows there are."""
    monkeypatch.setattr(hard_negatives, "SLACK", 3)
    r = np.random.default_rng(3)
    own = {"vec_id": np.array([0]), "label": np.array([1]), "v": np.array([[256.0, 0.0]])}
    rows = spark.createDataFrame([(7 * i + 1, [float(x), 0.0], 1) for i, x in enumerate(r.integers(-9, 9, 5000))], "vec_id long, embedding array<double>, label long")
    rows = rows.select("vec_id", "label", "embedding")
    windows = hard_negatives.Windows(own, np.array([0]), np.array([-(10**9)]), np.array([10**9]), True, 5)
    best = [(x.vec_id, x.score) for x in hard_negatives._best(rows, windows).orderBy("rank").collect()]
    plain = sorted(((x.vec_id, int(x.embedding[0] * 65536)) for x in rows.collect() ), key=lambda x: (-x[1], x[0]))
    assert best == plain[:5]
    ids = np.arange(5000) * 7 + 1
    w, *_ = windows.gathered(ids, np.ones(5000, np.int64), np.array([[x.embedding[0] * 256, 0.0] for x in rows.orderBy("vec_id").collect()]))
    assert 5 <= len(w) <= 5 + 3


# -- shards


def test_the_matrix_has_exact_margins():
    r = random.Random(4)
    for seed in range(60):
        counts = [r.choice([0, 1, 5, 40, 3000]) for _ in range(r.randrange(1, 9))]
        m = sharding.communication_matrix(counts, 24, seed)
        assert m.sum(axis=1).tolist() == counts and np.ptp(m.sum(axis=0)) <= 1 and (m >= 0).all()


def test_draws_for_large_counts_have_the_same_distribution(monkeypatch):
    a, b = np.random.default_rng(5), np.random.default_rng(6)
    numpys = np.array([a.hypergeometric(4000, 60_000, 900) for _ in range(20_000)])
    monkeypatch.setattr(sharding, "_EXACT", 0)
    own = np.array([sharding._hypergeometric(b, 4000, 60_000, 900) for _ in range(20_000)])
    assert abs(own.mean() - numpys.mean()) < 0.25 and abs(own.std() / numpys.std() - 1) < 0.03
    for good, bad, n in ((1, 0, 1), (0, 5, 3), (7, 3, 10), (2, 9, 1), (5, 5, 9)):
        assert max(0, n - bad) <= sharding._hypergeometric(b, good, bad, n) <= min(good, n)
    big = sharding._hypergeometric(b, 10**12, 23 * 10**12, 1 << 20)
    assert abs(big - (1 << 20) / 24) < 10 * (1 << 20) ** 0.5


def _law(rows, docs, shards=24):
    """Checks the law of rows, the slots, the sizes and the checksums."""
    assert Counter(x.doc_id for x in rows) == Counter(i for i, _ in docs)
    sizes = Counter({s: 0 for s in range(shards)}) + Counter(x.shard for x in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(x.slot for x in rows if x.shard == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in rows) == want
    assert {(x.law, x.grown_shard) for x in rows} <= {("rows", None)}


def test_shards_keep_the_law(spark, tmp_path, monkeypatch):
    docs = [(i if i % 11 else None, [None, "", "é" * i, "same text", "x" * 200_000 if i == 77 else "y"][i % 5]) for i in range(1000)] + [(5, "again"), (5, "again")]
    df = spark.createDataFrame([(*d, 3, "s") for d in docs], "doc_id long, text string, shard int, law string")
    df.repartition(6).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    first = sharding.assign(stored, chunk_rows=15).collect()
    _law(first, docs)
    # other splits of the files give the same shards and slots
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        again = sharding.assign(stored, chunk_rows=15).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(str, first)) == sorted(map(str, again))
    _law(sharding.assign(stored.where("doc_id % 2 = 0")).collect(), [d for d in docs if d[0] is not None and d[0] % 2 == 0])
    _law(sharding.assign(df, shards=7).collect(), docs, 7)
    _law(sharding.assign(stored.limit(5)).collect(), [(x.doc_id, x.text) for x in stored.limit(5).collect()])
    assert sharding.assign(stored.limit(0)).count() == 0


def test_shards_are_a_uniform_shuffle(spark, tmp_path):
    """Over many seeds: each row is in each shard and slot equally often, and neighbours don't stay together."""
    spark.range(48).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).repartition(3).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    cells, together, runs = np.zeros((48, 4, 12)), 0, 40
    for seed in range(runs):
        rows = sharding.assign(stored, shards=4, seed=seed, chunk_rows=5).collect()
        at = {x.doc_id: x.shard for x in rows}
        together += sum(at[i] == at[i + 1] for i in range(47))
        for x in rows:
            cells[x.doc_id, x.shard, x.slot] += 1
    assert abs(together / (runs * 47) - 11 / 47) < 0.03
    for axis, n in ((2, 4), (1, 12)):  # shards of each row, then slots of each row
        seen = cells.sum(axis=axis)
        chi = ((seen - runs / n) ** 2 / (runs / n)).sum()
        degrees = 48 * (n - 1)
        assert abs(chi - degrees) < 6 * (2 * degrees) ** 0.5


def test_written_shards_hold_the_texts_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((x.doc_id, x.text) for x in back.collect()) == Counter((x.doc_id, x.text) for x in docs.collect())
    for s in range(5):
        slots = [x.slot for x in spark.read.parquet(str(tmp_path / "out" / f"shard={s}")).collect()]
        assert sorted(slots) == list(range(len(slots)))
