"""The text operators and the pipeline on small tables, with every odd case, against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import byte_bpe, decontam, html_blocks, lang_gru, line_rules, near_dup, pseudo_lm, queries, quotes, site_quality, toxic_crf
from tests.conftest import DATA, same_as_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, id string, label int, path string"


def odd_documents(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(5)) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(120).split()
    near = lambda: " ".join([*base[:30], r.choice(words), *base[31:]])
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One  TWO"), (6, " ".join(base)), (7, " ".join(base).upper()), (8, near()), (9, near()), (10, text(30000)), (10, "repeated id"), (None, text(50)), (11, "…!?"), (12, "\x00 ﻿ é́")]
    rows += [(20 + i, text(60) + "\nthe same line on every page\n" + text(40)) for i in range(30)]
    return spark.createDataFrame([(i, t, r.choice(["en", "de", None]), r.choice(["s/a", "s/b", None, "q"]), len(t or ""), 0.5, None, "x", 1, None) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return odd_documents(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(1, 50)] + [(3, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    same_as_sql(spark, queries.queries()[name], queries.oracle_sql()[name])


def operators(docs, labels, items):
    return {
        "op3": lang_gru.identify(docs), "op4": near_dup.near_duplicates(docs), "op5": byte_bpe.encode_documents(docs), "op6": decontam.contamination(docs, items), "op7": pseudo_lm.pseudo_likelihood(docs),
        "op8": site_quality.quality(docs, labels), "op9": line_rules.apply_line_rules(docs), "op10": toxic_crf.toxicity(docs, labels),
    }


def test_odd_cases_and_empty_tables(spark, docs, labels):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "one two")], "item_id long, text string")
    n = docs.count()
    for name, found in operators(docs, labels, items).items():
        rows = found.collect()
        assert len(rows) == (6 if name == "op6" else n), name
    for name, found in operators(docs.limit(0), labels.limit(0), items.limit(0)).items():
        assert found.collect() == [], name
    for name, found in operators(docs, labels.limit(0), items.limit(0)).items():
        assert found.count() == (0 if name == "op6" else n), name


def test_near_duplicates_of_odd_documents(docs):
    found = {}
    for r in near_dup.near_duplicates(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert [found[i][0].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [found[i][0].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 2, 3, 4, 4, 6, 6, 6, 6]
    assert [found[i][0].kept for i in (4, 5, 6, 9)] == [True, False, True, False] and found[None][0].component_id is None


def test_near_duplicates_against_brute_force(spark):
    """Clouds of copies whose links run along chains, over several blocks."""
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for group in range(6):
        text = [r.choice(vocabulary) for _ in range(80)]
        for _ in range(60):
            copy = list(text)
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(80)] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
            if r.random() < 0.3:
                text = copy
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(76)) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    near_dup.BLOCK, keep = 16, near_dup.BLOCK
    try:
        found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        near_dup.BLOCK = keep
    assert {x.doc_id: x.component_id for x in found} == {i: top(i) for i in range(len(rows))}


def test_line_rules_by_join_and_by_table(docs):
    one = {(r.doc_id, r.clean_text): r for r in line_rules.apply_line_rules(docs, share=0.2).drop("text").collect()}
    two = {(r.doc_id, r.clean_text): r for r in line_rules.apply_line_rules(docs, share=0.2, broadcast_lines=-1).drop("text").collect()}
    assert one == two
    hit = [r for r in one.values() if r.n_removed_lines]
    assert hit and all("the same line" not in r.clean_text and r.kept for r in hit)


def test_decontamination_in_slices(spark, docs):
    text = docs.where("doc_id = 10 and length(text) > 100").first().text
    items = spark.createDataFrame([(1, " ".join(text.split()[20000:20040])), (2, "one two"), (3, "nothing of this is there at all today")], "item_id long, text string")
    decontam.SLICE_BYTES, keep = 40, decontam.SLICE_BYTES
    try:
        sliced = sorted((r.doc_id, r.item_id) for r in decontam.contamination(docs, items).collect())
    finally:
        decontam.SLICE_BYTES = keep
    assert sliced == sorted((r.doc_id, r.item_id) for r in decontam.contamination(docs, items).collect()) == [(4, 2), (5, 2), (10, 1)]


def test_encoding_round_trip(docs):
    encoded = byte_bpe.encode_documents(docs)
    assert {(r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode_documents(encoded).collect()} == {(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()}
    for r in encoded.join(docs.select("doc_id", "text"), "doc_id").where("doc_id <> 10").collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and r.n_tokens == len(r.token_ids)


def test_language_of_odd_texts(docs):
    found = {r.doc_id: r for r in lang_gru.identify(docs).collect()}
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (1, 2, 3, 11)) and found[4].lang_pred in ("en", "de")


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found = lang_gru.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    scored = toxic_crf.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in scored if a.toxic for b in scored if not b.toxic]
    assert sum(pairs) / len(pairs) > 0.8
    judged = site_quality.quality(docs, labels).join(labels, "doc_id").select("score", "quality").collect()
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in judged if a.quality for b in judged if not b.quality]
    assert sum(pairs) / len(pairs) > 0.9


def test_spans_are_the_words(spark):
    docs = spark.createDataFrame([(i, ("you IDIOT and Scum, " if i % 2 else "you dear and good, ") + f"word{i} goes on") for i in range(200)] + [(999, None)], "doc_id long, text string")
    labels = docs.where("doc_id < 200").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = {r.doc_id: r for r in toxic_crf.toxicity(docs, labels).join(docs, "doc_id").collect()}
    assert all((rows[i].predicted == i % 2) for i in range(200)) and rows[999].spans == []
    assert "IDIOT" in {rows[1].text[s.start : s.end] for s in rows[1].spans} | set(rows[1].text[rows[1].spans[0].start : rows[1].spans[-1].end].split())


def test_sparse_sites_shrink(spark):
    docs = spark.createDataFrame([(i, "some plain words here", f"h{i % 2}/p{i % 4}") for i in range(400)] + [(400, "x", "new/p"), (401, "x", None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0 or i % 8 == 1)) for i in range(400)], "doc_id long, quality int")
    rate = {r.doc_id: r.site_rate for r in site_quality.quality(docs, labels).collect()}
    assert rate[0] > 0.9 and rate[3] < 0.4 and rate[1] > rate[3] and abs(rate[400] - rate[401]) < 1e-9 and 0.5 < rate[400] < 0.75


def test_pseudo_likelihood_prefers_word_order_of_the_corpus(spark):
    text = " ".join(["alpha beta gamma delta epsilon zeta eta theta"] * 40)
    docs = spark.createDataFrame([(i, text) for i in range(60)] + [(100, "theta gamma alpha beta zeta " * 20), (101, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in pseudo_lm.pseudo_likelihood(docs).collect()}
    assert found[0].mean_pll > found[100].mean_pll and found[101].n_words == 0 and found[101].pll == 0 and found[101].mean_pll is None


def test_conversations(spark):
    rows = [
        (1, 0, "a", "Shall we meet?\nAt noon."), (1, 1, "b", "> Shall we meet?\nYes."), (1, 2, "c", "B wrote:\n> Yes.\n>> Shall we meet?\nGood."), (1, 3, "a", "> at   NOON.\nWhy noon?"), (1, 4, "d", "Another topic"),
        (1, 4, "d", "Another topic"), (2, 0, "a", "> Shall we meet?\nalone"), (None, 0, "a", "> x"), (3, None, "a", None),
    ]
    found = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == len(rows)
    by = {(r.conv_id, r.turn): r for r in found}
    assert [by[1, k].parent_turn for k in range(5)] == [None, 0, 1, 0, None]
    assert [(by[1, k].root_turn, by[1, k].depth) for k in range(5)] == [(0, 0), (0, 1), (0, 2), (0, 1), (4, 0)]
    assert by[1, 2].clean_text == "Good." and [tuple(q) for q in by[1, 2].quoted] == [(1, 1), (2, 0)]
    assert by[2, 0].parent_turn is None and by[2, 0].clean_text == "alone" and by[3, None].clean_text == ""
    assert [r.turn for r in sorted((r for r in found if r.conv_id == 1), key=lambda r: r.reply_order)] == [0, 1, 3, 2, 4, 4]
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article><p>a  b", "y"), (2, None, "<article><p>a  b", "y")], "page_id long, url string, html string, main_text string")
    assert sorted((r.page_id, r.main_text) for r in html_blocks.extract(pages).collect()) == [(1, ""), (2, "a b"), (2, "a b")]


def test_pipeline_stages_against_their_operators(spark, docs):
    """Each stage keeps exactly what its operator says, and hands on the columns of its input."""
    given, sf = docs.select("doc_id", "text", "lang", "source", "n_chars"), DATA
    ids = lambda d: sorted(str(r.doc_id) for r in d.select("doc_id").collect())
    ruled = corpus_pipeline.quality_rules(spark, given, sf)
    assert ids(ruled) == ids(line_rules.apply_line_rules(given, share=0.0, all_docs=8).where("kept")) and ruled.columns == given.columns
    named = corpus_pipeline.language_id(spark, given, sf)
    assert ids(named) == ids(lang_gru.identify(given).where("lang_pred <> 'und' and score >= 0.5")) and named.columns == given.columns
    alone = corpus_pipeline.near_dedup(spark, given, sf)
    assert ids(alone) == ids(near_dup.near_duplicates(given, percent=80).where("kept")) and alone.columns == given.columns
    assert corpus_pipeline.decontamination(spark, given, sf).columns == given.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, given.limit(0), sf).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    final = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 0 < final.count() < docs.count()
    leaks = {r.doc_id for r in decontam.contamination(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    kept = {r.doc_id for r in final.collect()}
    failed = {r.doc_id for r in line_rules.apply_line_rules(docs).where("not kept").collect()}
    assert leaks and not kept & leaks and not kept & failed
