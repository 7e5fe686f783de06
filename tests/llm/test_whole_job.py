"""Cases in which an operator or a stage once did less than the whole job."""

import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import line_rules, near_dup, pseudo_lm, quotes, site_quality, toxic_crf
from pagewright.llm.common import hash_words, words_of
from pagewright.llm.queries import OP9_SQL
from tests.conftest import DATA


def test_shared_lines_of_large_hosts_and_over_hosts_go(spark):
    """A line in 3 % of a host's documents, and one that stands once on each of many hosts."""
    body = lambda i: " ".join(f"own{i}word{k}" for k in range(20))
    rows = [(i, body(i) + ("\nSubscribe to   our letter" if i < 12 else "\nseven hold this" if i < 19 else ""), "big") for i in range(400)]
    rows += [(1000 + i, body(1000 + i) + "\nspread over the hosts", f"h{i}") for i in range(9)]
    rows += [(2000 + i, body(2000) + "\nexact copies count once", f"c{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, DATA).collect()}
    gone = {i for i, t, _ in rows if kept[i] != t}
    assert gone == {*range(12), *range(1000, 1009)} and all("\n" not in kept[i] for i in gone)
    ways = [line_rules.apply_line_rules(docs, share=0.0, all_docs=8, broadcast_lines=n).select("doc_id", "clean_text", "n_removed_lines").collect() for n in (500_000, -1)]
    assert sorted(ways[0]) == sorted(ways[1]) and sum(r.n_removed_lines for r in ways[0]) == len(gone)


def test_each_word_is_scored_by_its_own_count(spark):
    """All words sent, some joined, all joined: the same scores, those of plain counts outside the document."""
    rows = [(i, " ".join(["often"] * 50 + [f"w{i % 40}", f"x{i % 4}", f"only{i}"])) for i in range(90)] + [(90, None), (90, "often"), (None, "w1 w1"), (91, "twice here too"), (92, "twice here too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words, n = pseudo_lm.corpus_words(docs), Counter(w for _, t in rows for w in words_of(t))
    flat = pseudo_lm.fit(docs, words)
    hashes = hash_words(list(n))
    classes, context = words.codes(hashes)
    assert words.words.count() == len(n) and (context < pseudo_lm.SLOTS).sum() >= 4 and set(classes[context == pseudo_lm._OTHER]) == {pseudo_lm.CLASSES - 1}
    count = np.array(list(n.values()))
    mass = np.log([count[classes == c].sum() + pseudo_lm.ALPHA * ((classes == c).sum() + 1) for c in range(pseudo_lm.CLASSES)])
    assert np.allclose(words.log_mass, mass)
    want = []
    for i, t in rows:
        own = words_of(t)
        wanted, context = words.codes(hash_words(own))
        probs = pseudo_lm.forward(flat, pseudo_lm.windows([context]))[2]
        logs = [np.log(probs[k, c]) + np.log(n[w] - own.count(w) + pseudo_lm.ALPHA) - mass[c] for k, (w, c) in enumerate(zip(own, wanted, strict=True))]
        want.append((str(i), len(own), sum(n[w] == own.count(w) for w in own), sum(logs)))
    for sent_words in (1 << 19, 60, 0):
        some = pseudo_lm.corpus_words(docs, sent_words=sent_words)
        assert (some.rare is None) == (sent_words > 60) and len(some.sent[0]) <= sent_words
        found = [(str(r.doc_id), r.n_words, r.n_unseen, r.pll) for r in pseudo_lm.score(docs, flat, some).collect()]
        assert [x[:3] for x in sorted(found)] == [x[:3] for x in sorted(want)]
        assert np.allclose([x[3] for x in sorted(found)], [x[3] for x in sorted(want)], atol=0.01)
    assert {x[0]: x[2] for x in want}["91"] == 0 and {x[0]: x[2] for x in want}["5"] == 1


def test_the_network_learns_from_contexts(spark):
    """Documents left out of the fit: contexts beat the class shares, and the text beats its shuffled words."""
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").where("text is not null").select("doc_id", "text")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    words = pseudo_lm.corpus_words(docs)
    flat = pseudo_lm.fit(docs.where(~out), words)
    own, free, mixed, n, r = 0.0, 0.0, 0.0, 0, np.random.default_rng(1)
    share = np.log(words.class_words / words.class_words.sum() + 1e-30)
    for row in docs.where(out).collect():
        hashes = hash_words(words_of(row.text))
        if len(hashes) > 20:
            for k, given in enumerate((hashes, r.permutation(hashes))):
                wanted, context = words.codes(given)
                logs = np.log(pseudo_lm.forward(flat, pseudo_lm.windows([context]))[2][np.arange(len(given)), wanted]).sum()
                own, mixed = (own + logs, mixed) if k == 0 else (own, mixed + logs)
            free += share[wanted].sum()
            n += len(hashes)
    assert own / n > free / n + 0.1 and own / n > mixed / n + 0.01


def test_pairs_from_the_limit_up_are_near_duplicates(spark):
    """Pairs round both limits against brute force; those from 0.80 up to 0.85 are one document to the pipeline."""
    r = random.Random(31)
    rows, share = [], {}
    for pair in range(400):
        text = [f"p{pair}w{k}" for k in range(204)]
        copy, cut = list(text), r.randrange(12, 26)
        copy[-cut:] = [f"p{pair}n{k}" for k in range(cut)]
        sets = [{tuple(t[i : i + 5]) for i in range(200)} for t in (text, copy)]
        share[2 * pair + 1] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * pair, " ".join(text)), (2 * pair + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        want = {i for i, x in share.items() if 100 * x >= percent}
        assert want and {x.doc_id for x in near_dup.near_duplicates(docs, percent=percent).where("not kept").collect()} == want
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, DATA).collect()}
    assert kept == {i for i, _ in rows} - {i for i, x in share.items() if x >= 0.8}
    assert near_dup.agreeing(85) == 90 and near_dup.agreeing(80) < 85


def test_texts_of_one_id_are_one_document(spark):
    """Links of both texts of a repeated id count, and its rows share one component, the empty one too."""
    r = random.Random(4)
    a, b = ([f"{x}{r.randrange(10**6)}" for _ in range(100)] for x in "ab")
    near = lambda t: " ".join([*t[:-3], "other", *t[-2:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (3, near(a)), (3, ""), (4, ""), (5, "one two"), (5, "one two")]
    for order in (rows, rows[::-1]):
        found = near_dup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((x.doc_id, x.component_id, x.kept) for x in found) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (5, 5, True)]


def test_names_that_clash_with_results(spark):
    """Columns of the results' names are replaced by the operator, and handed on by the pipeline's stage."""
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(i, f"{text} {i}\nsame line", "s", "en", 3, 7, 8, "c", "r") for i in range(9)], "doc_id long, text string, source string, lang string, n_chars long, n_words long, _removed long, kept string, row string")
    for lines in (500_000, -1):
        found = line_rules.apply_line_rules(docs, share=0.0, broadcast_lines=lines).collect()
        assert {(r.n_words, r.kept, r._removed, r.row, r.n_removed_lines) for r in found} == {(33, True, 8, "r", 1)}
    handed = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert handed.columns == docs.columns and {(r.n_words, r._removed, r.kept, r.n_chars) for r in handed.collect()} == {(7, 8, "c", len(text) + 2)}


def test_threads_against_plain_search(spark):
    """Generated threads with nested, partial and repeated quotations, ties of turns and large turns."""
    r = random.Random(17)
    rows = []
    for conv in range(12):
        base, said = r.choice([0, -5, 1_700_000_000_000]), []
        for k in range(25):
            turn = base + k - (k % 7 == 6)
            own = "\n".join(f"line {conv % 3} {r.randrange(30)} of {k}" if r.random() < 0.7 else f"common {r.randrange(3)}" for _ in range(r.randrange(1, 4)))
            quoted = ""
            if said and r.random() < 0.7:
                picked = r.choice(said).split("\n")
                quoted = "\n".join("> " + x if not x.startswith(">") else ">" + x for x in picked[: r.randrange(1, len(picked) + 1)]) + "\n"
            said.append(quoted + own)
            rows.append((conv, turn, "u", said[-1].upper() if r.random() < 0.1 else said[-1]))
    found = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    parsed = [(c, t, *quotes.parse(x)) for c, t, _, x in rows]
    parent = {}
    for c, t, _, quoted in parsed:
        for level, body in quoted:
            for key, size in quotes.passages(body).items():
                if level == 1:
                    holders = [u for d, u, own, _ in parsed if d == c and u < t and key in quotes.passages(own)]
                    if holders:
                        score = parent.setdefault((c, t), Counter())
                        score[max(holders)] += size
    best = {at: max(score, key=lambda u: (score[u], u)) for at, score in parent.items()}

    def chain(c, t):
        return chain(c, best[c, t]) + [t] if (c, t) in best else [t]

    assert best and len(found) == len(rows)
    for x in found:
        path = chain(x.conv_id, x.turn)
        assert (x.parent_turn, x.root_turn, x.depth) == (best.get((x.conv_id, x.turn)), path[0], len(path) - 1)
        assert x.reply_order == [path[0], len(path) - 1, x.turn]


def test_posteriors_without_the_own_label_against_plain_sums(spark):
    r = random.Random(3)
    rows = [(i, "plain words", f"h{i % 5}/a/{i % 3}" if i % 4 else f"h{i % 5}") for i in range(300)]
    labels = {i: int(r.random() < 0.2 + 0.15 * (i % 5)) for i in range(200)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    found = {x.doc_id: x.site_rate for x in site_quality.quality(docs, known).collect()}
    split = {i: (s.split("/", 1) + [""])[:2] for i, _, s in rows}
    sited = docs.join(known, "doc_id").select(*site_quality._site("source"), F.col("quality").cast("double").alias("label"))
    assert {x.path for x in sited.collect()} == {"", "a/0", "a/1", "a/2"}
    rate, k_host, k_path = site_quality.site_sums(sited)[2]
    for i, (host, path) in split.items():
        others = [(split[j], y) for j, y in labels.items() if j != i]
        in_host, in_path = [y for (h, _), y in others if h == host], [y for (h, p), y in others if (h, p) == (host, path)]
        above = (sum(in_host) + k_host * rate) / (len(in_host) + k_host)
        assert abs(found[i] - (sum(in_path) + k_path * above) / (len(in_path) + k_path)) < 1e-9


def test_quality_of_documents_without_labels(spark):
    """Half of the labels are kept from the operator and judged by it."""
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    own = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    judged = site_quality.quality(docs, labels.where(own)).join(labels.where(~own), "doc_id").select("score", "quality").collect()
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in judged if a.quality for b in judged if not b.quality]
    assert sum(pairs) / len(pairs) > 0.85


def test_spans_behind_letters_that_grow_in_lower_case(spark):
    docs = spark.createDataFrame([(i, ("İİİ you IDIOT and Scum, " if i % 2 else "İ you dear and good, ") + f"word{i} goes on") for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    for fit_bytes in (10**7, 4000):
        crf = toxic_crf.fit(toxic_crf.labelled(docs, labels, fit_bytes=fit_bytes))
        row = {x.doc_id: x for x in toxic_crf.tag(docs, crf).join(docs, "doc_id").collect()}[1]
        assert row.predicted == 1 and "IDIOT" in row.text[row.spans[0].start : row.spans[-1].end].split()
    assert sum(len(t.encode()) for t, _ in toxic_crf.labelled(docs, labels, fit_bytes=4000)) <= 4000


def _near_copies(seed: int):
    """Documents of five groups of near copies over three hosts, some of one page line in common, and loners with short texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = []
    for g, n in enumerate((7, 9, 14, 30, 60)):
        base = [[word() for _ in range(12)] for _ in range(10)]
        for _ in range(n):
            lines = [list(x) for x in base]
            lines[r.randrange(10)][r.randrange(12)] = word()  # 6 % of a text's shingles: two copies are 88 % alike or more
            rows.append(("\n".join(" ".join(x) for x in lines) + ("\nread all of this on the page" if g % 2 else ""), f"h{r.randrange(3)}"))
    rows += [(" ".join(word() for _ in range(r.randrange(9, 40))) + "\nshort and common line here", f"h{r.randrange(3)}") for _ in range(20)]
    rows += [rows[0]] * 3 + [(None, "h0"), ("", None), ("short and common line here", None)]
    r.shuffle(rows)
    return [(i, *row) for i, row in enumerate(rows)]


def _plain_votes(rows, percent):
    """Removed lines of each document, by comparing all pairs of covered texts."""
    norm = lambda line: " ".join(line.lower().split())
    lines = lambda t: [norm(x) for x in (t or "").split("\n")]

    def above(vote):
        held = {}
        for _, text, host in rows:
            for k in set(lines(text)) - {""}:
                held.setdefault((host or "", k), set()).add(vote(text))
                held.setdefault((None, k), set()).add(vote(text))
        return {key for key, votes in held.items() if len(votes) >= 8}

    gone = lambda found, host, text: [k for k in lines(text) if k and ((host or "", k) in found or (None, k) in found)]
    first = above(lambda t: t)
    covered = {t for _, t, h in rows if t and 4 * sum(len(k.split()) for k in gone(first, h, t)) >= len(t.split()) and gone(first, h, t)}
    sets = {t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t in covered for w in [t.lower().split()]}
    group = {t: t for t in covered}
    for a in covered:
        for b in covered:
            if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old = group[a]
                for t in covered:
                    if group[t] == old:
                        group[t] = group[b]
    last = above(lambda t: ("group", group[t]) if t in group else t)
    return first, {i: len(gone(last, h, t)) for i, t, h in rows}


def test_near_copies_count_once_for_a_line(spark):
    """Groups of near copies stay with all their lines, lines of unlike documents go; keys sent and joined agree with all pairs."""
    rows = _near_copies(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, plain = _plain_votes(rows, line_rules.GROUP_PERCENT)
    for n in (500_000, -1):
        found = {r.doc_id: r for r in line_rules.apply_line_rules(docs, **line_rules.LIMITS, broadcast_lines=n).collect()}
        assert {i: r.n_removed_lines for i, r in found.items()} == plain
        assert all(found[i].kept for i, t, _ in rows if t and t.count("\n") >= 9)
    assert len(first) > 40 and 0 < sum(map(bool, plain.values())) < 40
    alone = {r.doc_id: r.kept for r in line_rules.apply_line_rules(docs, share=0.0, all_docs=8).collect()}
    assert sum(not alone[i] for i, t, _ in rows if t and t.count("\n") >= 9) > 100


def test_near_copies_in_empty_tables_and_without_frequent_lines(spark):
    schema = "doc_id long, text string, source string, text_key string"
    for rows in ([], [(1, None, None, "x"), (None, "one two three four five six seven eight nine ten", "h", "y")]):
        found = line_rules.apply_line_rules(spark.createDataFrame(rows, schema), **line_rules.LIMITS).collect()
        assert [(r.n_removed_lines, r.text_key) for r in sorted(found, key=lambda r: r.text_key)] == [(0, "x"), (0, "y")][: len(rows)]


def test_rules_agree_with_their_sql_on_near_copies(spark):
    import duckdb

    rows = _near_copies(8)
    found = line_rules.apply_line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), **line_rules.LIMITS, clean_col=None).drop("text", "source")
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?)", rows)
    right = c.execute(f"select {', '.join(found.columns)} from ({OP9_SQL})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(right)
