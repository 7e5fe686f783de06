"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the two words before and the two behind it, itself masked.  The probability of a word has
two factors: its class given the window (the network), and the word given the class (its own count in the corpus).  A
document's score is the sum of the conditional log-probabilities of all its words.

Words are hashed to ``SLOTS`` slots.  The most frequent word of a slot is known to the network if it holds half of the
slot's occurrences: as a context it has its own vector, and as a target a class with words that stand in like company
(weighted k-means over the profiles of neighbours).  All other words share one context vector and the last class.  Within
a class each word's probability follows its own count outside the document that is scored, ``ALPHA`` added, so a word that
no other document holds counts as unseen however often the document repeats it.  (The classes' totals keep the document's
own words in.)

Two full passes gather from the corpus: exact counts of the distinct words, with the slots' profiles of neighbours, and
the network itself.  The network starts as the table of class shares, so it can only gain from contexts; every task
trains a copy in numpy (Adagrad) over all its documents, on every position, and the copies are averaged by
their numbers of words.  The average depends a little on how documents fall into tasks.  The counts are a table that
grows with the corpus and stays distributed: its most frequent words, at most ``sent_words``, are sent to the tasks, all
others are joined to the documents' words.  Those are all rarer than the words sent, so no key of the join is hot.  Of
fixed size are the network, the slots and the words sent.

Defined cases: a null or empty text has no words, pll 0 and a null mean; texts are read whole; an empty corpus gives an
empty result; repeated rows are documents of their own and count as often as they occur; a null id is carried; columns
that share a name with the results are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed, hash_words, mix64, texts, words_of

SLOTS = 4096
PROFILE = 32  # cells of a slot's profile: half for words before, half for words behind
CLASSES = 32
SENT_WORDS = 1 << 19
SIDE = 2
HIDDEN = 16
BATCH = 2048
RATE = 0.2
ALPHA = 0.1
LEAST = 20  # occurrences of a word that the network knows
ADDERS = 32
_OTHER, _PAD = SLOTS, SLOTS + 1
_SHAPES = [(SLOTS + 2, HIDDEN), (2 * SIDE, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]
SIZE = sum(int(np.prod(s)) for s in _SHAPES)


def _parts(flat: np.ndarray) -> list[np.ndarray]:
    """Word vectors, weights of the places in the window, hidden bias, output, output bias; views of ``flat``."""
    out, at = [], 0
    for shape in _SHAPES:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape))
        at += n
    return out


def start_parameters(class_words: np.ndarray, seed: int = 11) -> np.ndarray:
    r = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    vectors, places, _, out, out_bias = _parts(flat)
    vectors[:] = r.standard_normal(vectors.shape) * 0.3
    places[:] = 0.4
    out[:] = r.standard_normal(out.shape) * 0.1
    out_bias[:] = np.log((class_words + 1) / (class_words + 1).sum())
    return flat


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) % np.uint64(SLOTS)).astype(np.int64)


def windows(contexts: list[np.ndarray]) -> np.ndarray:
    """Context numbers round every word (words, 2 * SIDE); beyond a document's ends stands the pad."""
    gap = np.full(SIDE, _PAD)
    line = np.concatenate([gap, *(x for c in contexts for x in (c, gap))])
    inside = np.concatenate([np.arange(len(c)) for c in contexts]) if contexts else np.empty(0, np.int64)
    starts = np.cumsum([SIDE, *(len(c) + SIDE for c in contexts)])[: len(contexts)]
    place = inside + np.repeat(starts, [len(c) for c in contexts])
    return np.stack([line[place + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1).astype(np.int64)


def forward(flat: np.ndarray, window: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Context vectors, hidden states and class probabilities."""
    vectors, places, bias, out, out_bias = _parts(flat)
    found = [vectors.take(window[:, k], 0) for k in range(2 * SIDE)]
    a = found[0] * places[0]
    for k in range(1, 2 * SIDE):
        a += found[k] * places[k]
    a += bias
    h = np.tanh(a, out=a)
    p = out.T @ h.T  # a row for each class: sums and maxima over rows are vectorised
    p += out_bias[:, None]
    p -= p.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    return found, h, p.T


def gradients(flat: np.ndarray, window: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of the mean negative log-probability of the wanted classes."""
    _, places, _, out, _ = _parts(flat)
    found, h, d = forward(flat, window)
    d[np.arange(len(wanted)), wanted] -= 1
    d /= len(wanted)
    da = (d @ out.T) * (1 - h * h)
    grad = np.empty_like(flat)
    g_vectors, g_places, g_bias, g_out, g_out_bias = _parts(grad)
    at = window.T.ravel()
    da_columns, place_columns = da.T.astype(np.float64), places.T.astype(np.float64)  # what bincount adds up in
    for j in range(HIDDEN):
        g_vectors[:, j] = np.bincount(at, np.multiply.outer(place_columns[j], da_columns[j]).ravel(), SLOTS + 2)
    for k in range(2 * SIDE):
        g_places[k] = np.einsum("nh,nh->h", da, found[k])
    g_bias[:], g_out[:], g_out_bias[:] = np.ones(len(da), da.dtype) @ da, h.T @ d, d.sum(0)
    return grad


def train(flat: np.ndarray, squares: np.ndarray, window: np.ndarray, wanted: np.ndarray, rate: float = RATE) -> None:
    """One pass of Adagrad steps over the words, in place."""
    held = np.empty_like(flat)
    for i in range(0, len(wanted), BATCH):
        g = gradients(flat, window[i : i + BATCH], wanted[i : i + BATCH])
        squares += np.multiply(g, g, out=held)
        g /= np.sqrt(squares, out=held)
        g *= rate
        flat -= g


def word_classes(profiles: np.ndarray, weights: np.ndarray, classes: int, seed: int = 3) -> np.ndarray:
    """Class of each row of counts: weighted k-means over the square roots of the rows' shares."""
    if not len(profiles):
        return np.empty(0, np.int64)
    x = np.sqrt((profiles + 0.5) / (profiles.sum(1, keepdims=True) + 0.5 * profiles.shape[1]))
    r = np.random.default_rng(seed)
    centres, near = [x[weights.argmax()]], np.full(len(x), np.inf)
    for _ in range(min(classes, len(x)) - 1):
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
        chance = near * weights
        if not chance.sum():
            break
        centres.append(x[r.choice(len(x), p=chance / chance.sum())])
    centre = np.stack(centres)
    for _ in range(25):
        own = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        for j in np.unique(own):
            centre[j] = np.average(x[own == j], axis=0, weights=weights[own == j])
    return own


class Words:
    """What the counts say: ``words (word, n)`` has all words, ``rare`` those that are not sent (or is None), ``lead`` the
    known word of each slot (0: none) and ``classes`` its class."""

    def __init__(self, counted: DataFrame, sent_words: int = SENT_WORDS):
        self.words = words = counted.where("not cell").select("word", "n")
        cells = counted.where("cell").select("word", "n").toArrow()
        profile = np.zeros(SLOTS * PROFILE)
        profile[cells.column(0).to_numpy()] = cells.column(1).to_numpy()

        def by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, n = (batch.column(k).to_numpy() for k in (0, 1))
                at = _slot(word.view(np.uint64))
                order = np.lexsort((word, n, at))
                last = order[np.r_[at[order][1:] != at[order][:-1], True]] if len(at) else order
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[last]), pa.array(n[last]), pa.array(word[last]), pa.array(np.bincount(at, n, SLOTS)[at[last]].astype(np.int64)), pa.array(np.bincount(at, minlength=SLOTS)[at[last]])],
                    names=["slot", "n", "word", "total", "kinds"],
                )

        slots = words.mapInArrow(by_slot, "slot long, n long, word long, total long, kinds long").groupBy("slot")
        found = slots.agg(F.max(F.struct("n", "word")).alias("lead"), F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).collect()
        held, lead, total = np.zeros(SLOTS), np.zeros(SLOTS, np.int64), np.zeros(SLOTS)
        for r in found:
            held[r.slot], lead[r.slot], total[r.slot] = r.lead.n, r.lead.word, r.total
        known = np.flatnonzero((held >= LEAST) & (2 * held >= total))
        self.lead = np.where(np.isin(np.arange(SLOTS), known), lead, 0)
        self.classes = np.full(SLOTS + 1, CLASSES - 1)
        self.classes[known] = word_classes(profile.reshape(SLOTS, PROFILE)[known], held[known], CLASSES - 1)
        self.class_words = np.bincount(self.classes[known], held[known], CLASSES)
        self.class_words[-1] += total.sum() - held[known].sum()
        kinds = np.bincount(self.classes[known], minlength=CLASSES).astype(float)
        kinds[-1] += sum(r.kinds for r in found) - len(known)
        self.log_mass = np.log(self.class_words + ALPHA * (kinds + 1))  # one share for a word the corpus lacks
        # Words are sent from the highest power of two in their counts downwards, as long as they fit.
        level = F.length(F.bin("n"))
        least, room = None, sent_words
        for r in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("kinds")).collect(), reverse=True):
            room -= r.kinds
            if room < 0:
                break
            least = r.level
        self.rare = words.where(level < least) if least is not None else words
        if least == 1 or (least is not None and self.rare.isEmpty()):
            self.rare = None
        sent = words.where(level >= least).toArrow() if least is not None else None
        keys, n = (sent.column(k).to_numpy() for k in (0, 1)) if sent is not None else (np.empty(0, np.int64),) * 2
        order = np.argsort(keys)
        self.sent = keys[order], n[order]

    def codes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and context number of words."""
        return codes(self.lead, self.classes, hashes)


def codes(lead: np.ndarray, classes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = _slot(hashes)
    context = np.where(lead.take(at) == hashes.view(np.int64), at, _OTHER)
    return classes.take(context), context


def corpus_words(docs: DataFrame, text_col: str = "text", sent_words: int = SENT_WORDS) -> Words:
    """One pass counts the words and, as rows of the same table, the cells of the slots' profiles."""
    half = PROFILE // 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        profile = np.zeros(SLOTS * PROFILE, np.int64)

        def rows(keys: np.ndarray, cell: bool, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), cell)), pa.array(n)], names=["word", "cell", "n"])

        def counts() -> pa.RecordBatch:
            return rows(hash_words(list(seen)), False, np.fromiter(seen.values(), np.int64, len(seen)))

        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                many = [words_of(t) for t in texts(batch.column(0).slice(begin, 200))]
                for words in many:
                    seen.update(words)
                hashes = hash_words([w for words in many for w in words])
                owner = np.repeat(np.arange(len(many)), [len(w) for w in many])
                near = np.flatnonzero(owner[1:] == owner[:-1])  # a word and the next one of its document
                at, other = _slot(hashes) * PROFILE, ((mix64(hashes) >> np.uint64(40)) % np.uint64(half)).astype(np.int64)
                np.add.at(profile, np.concatenate([at[near + 1] + other[near], at[near] + half + other[near + 1]]), 1)
                if len(seen) > 200_000:
                    yield counts()
                    seen.clear()
        yield counts()
        cell = np.flatnonzero(profile)
        yield rows(cell, True, profile[cell])

    counted = docs.select(text_col).mapInArrow(count, "word long, cell boolean, n long").groupBy("word", "cell").agg(F.sum("n").alias("n"))
    return Words(checkpointed(counted), sent_words)


def fit(docs: DataFrame, words: Words, text_col: str = "text") -> np.ndarray:
    """Parameters averaged over tasks that each train over all their documents."""
    start = start_parameters(words.class_words)
    sent = docs.sparkSession.sparkContext.broadcast((start, words.lead, words.classes))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, lead, classes = sent.value
        own, squares, n = flat.copy(), np.full(SIZE, 1e-6, np.float32), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                coded = [codes(lead, classes, hash_words(words_of(t))) for t in texts(batch.column(0).slice(begin, 200))]
                if any(len(c[0]) for c in coded):
                    wanted = np.concatenate([c[0] for c in coded])
                    train(own, squares, windows([c[1] for c in coded]), wanted)
                    n += len(wanted)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(own.astype(np.float64) * n).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["total", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE), 0
        for batch in batches:
            for part, own in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
                total += np.frombuffer(part)
                n += own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["total", "n"])

    rows = docs.select(text_col).mapInArrow(learn, "total binary, n long").repartition(ADDERS).mapInArrow(add, "total binary, n long").collect()
    sent.unpersist()
    return (sum(np.frombuffer(r.total) for r in rows) / sum(r.n for r in rows)).astype(np.float32) if rows else start


def score(docs: DataFrame, flat: np.ndarray, words: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_words``, ``pll``, ``mean_pll`` and ``n_unseen``, the words that no other document holds."""
    sent = docs.sparkSession.sparkContext.broadcast((flat, words.lead, words.classes, words.log_mass, *words.sent))
    joined = words.rare is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, lead, classes, log_mass, sent_keys, sent_n = sent.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                many = [hash_words(words_of(t)) for t in texts(part.column(1))]
                sizes = np.array([len(h) for h in many])
                owner = np.repeat(np.arange(len(many)), sizes)
                total, unseen = np.zeros(len(many)), np.zeros(len(many))
                rare, times, ends = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(many) + 1, np.int32)
                if len(owner):
                    hashes = np.concatenate(many)
                    wanted, context = codes(lead, classes, hashes)
                    window = windows(np.split(context, np.cumsum(sizes)[:-1]))
                    logs = -log_mass[wanted]
                    for i in range(0, len(owner), BATCH):
                        probs = forward(flat, window[i : i + BATCH])[2]
                        logs[i : i + BATCH] += np.log(probs[np.arange(len(probs)), wanted[i : i + BATCH]] + 1e-30)
                    total = np.bincount(owner, logs, len(many))
                    # each document's distinct words, with their own occurrences
                    kinds, which = np.unique(hashes.view(np.int64), return_inverse=True)
                    pairs, own = np.unique(owner * len(kinds) + which, return_counts=True)
                    doc, kind = pairs // len(kinds), pairs % len(kinds)
                    at = np.minimum(np.searchsorted(sent_keys, kinds), max(0, len(sent_keys) - 1))
                    hit = (sent_keys[at] == kinds)[kind] if len(sent_keys) else np.zeros(len(pairs), bool)
                    n = np.where(hit, sent_n[at][kind] if len(sent_keys) else 0, own)
                    inside = hit if joined else np.ones(len(pairs), bool)
                    elsewhere = np.maximum(n - own, 0)[inside]
                    total += np.bincount(doc[inside], own[inside] * np.log(elsewhere + ALPHA), len(many))
                    unseen = np.bincount(doc[inside], own[inside] * (elsewhere == 0), len(many))
                    rare, times = kinds[kind[~inside]], own[~inside]
                    ends[1:] = np.cumsum(np.bincount(doc[~inside], minlength=len(many)))
                out = [part.column(0), pa.array(sizes, pa.int64()), pa.array(total, pa.float64()), pa.array(unseen.astype(np.int64))]
                if joined:
                    out += [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (rare, times)]
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_words", "pll", "n_unseen", *(["_rare", "_times"] if joined else [])])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, pll double, n_unseen long" + (", _rare array<bigint>, _times array<bigint>" if joined else ""))
    if joined:
        marked = checkpointed(out.withColumn("_row", F.monotonically_increasing_id()))
        held = marked.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("x")).select("_row", F.col("x._rare").alias("word"), F.col("x._times").alias("own"))
        elsewhere = F.greatest(F.coalesce("n", F.col("own")) - F.col("own"), F.lit(0))
        more = held.join(words.rare, "word", "left").groupBy("_row").agg(F.sum(F.col("own") * F.log(elsewhere + ALPHA)).alias("_more"), F.sum(F.when(elsewhere == 0, F.col("own")).otherwise(0)).alias("_lone"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        out = marked.drop("_rare", "_times").join(more, "_row", "left").select(id_col, "n_words", (F.col("pll") + zero("_more")).alias("pll"), (F.col("n_unseen") + zero("_lone")).alias("n_unseen"))
    return out.select(id_col, "n_words", "pll", F.when(F.col("n_words") > 0, F.col("pll") / F.col("n_words")).alias("mean_pll"), "n_unseen")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_words: int = SENT_WORDS) -> DataFrame:
    words = corpus_words(docs, text_col, sent_words)
    return score(docs, fit(docs, words, text_col), words, id_col, text_col)
