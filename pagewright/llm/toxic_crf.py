"""Toxicity by a linear-chain conditional random field over words.

Token labels come from the document labels: in a document marked toxic, the words whose form or beginning is found
mostly in toxic documents are tagged toxic (at least the most telling one), all other words are not.  A two-state chain
over hashed features of each word (the word, its beginnings of 3 to 8 letters, its last 3) is fitted to them in numpy by
gradient steps on the likelihood, whose gradients come from forward-backward marginals.  In a scored document the
marginals of all words are exact over its whole chain; their sum, maximum and count of likely words go through a
logistic function fitted on the labelled documents and give the score.  Runs of likely words are returned with offsets.

Fitted on at most ``FIT_DOCS`` labelled documents of least id hash outside the held-out third, and of these on as many as
fit into ``FIT_BYTES`` of text; a document that alone exceeds the room left is passed over.  Defined cases: an empty
or null text is scored like a text without toxic words, with no spans; if no labels or only one kind are there, every
score is the share of label 1 (0 without labels); an id with several labels counts as toxic if one of them is; repeated
rows are scored alike and one of them is fitted on; rows with a null id are scored but not held out; texts of any length
are read whole; an empty table gives an empty result; columns that share a name with the results are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import texts

FEATURES = 1 << 16
FORMS = 1 << 22  # places for counting forms when words are tagged
FIT_DOCS = 6000
FIT_BYTES = 24_000_000  # of text that the driver reads to fit
THRESHOLD = 0.7
STEPS = 80
_WORD = re.compile(r"\w+")
_CACHE_WORDS = 250_000  # about 40 MB


def words(text: str | None) -> list[str]:
    """Words in lower case, cut in the text as it is: a letter whose lower case is longer must not shift or split them."""
    if not text:
        return []
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def forms(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in range(3, 9) if len(word) > k), "$" + word[-3:]]


def hashed(word: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(f) for f in forms(word)]


def features(word: str) -> list[int]:
    return [h % FEATURES for h in hashed(word)]


class Packed:
    """Sequences laid out by time, longest first, so the ones still running stand together at each step."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        longest = int(lengths.max(initial=0))
        running = np.searchsorted(-lengths[order], -np.arange(longest), "left")  # with length > t
        self.start = np.concatenate([[0], np.cumsum(running)]).astype(np.int64)
        self.running = running
        self.owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        t = np.arange(len(self.owner), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        self.place = (self.start[t] + rank[self.owner]).astype(np.int32)


def forward_backward(unary: np.ndarray, links: np.ndarray, packed: Packed) -> tuple[np.ndarray, ...]:
    """P(tag = 1) of each word in text order, then scores and messages (log-odds of tag 1) in packed order.
    unary: score of tag 1 over tag 0 of each word; links[i, j]: score of tag j behind tag i."""
    u = np.empty(len(unary), unary.dtype)
    u[packed.place] = unary
    e = np.exp(links).astype(u.dtype)
    ahead, back = u.copy(), np.zeros_like(u)
    start, running = packed.start, packed.running
    for t in range(1, len(running)):
        n = running[t]
        odds = np.exp(np.minimum(ahead[start[t - 1] : start[t - 1] + n], 80))
        ahead[start[t] : start[t] + n] += np.log((e[0, 1] + e[1, 1] * odds) / (e[0, 0] + e[1, 0] * odds))
    for t in range(len(running) - 2, -1, -1):
        n, nxt = running[t + 1], start[t + 1]
        odds = np.exp(np.minimum(u[nxt : nxt + n] + back[nxt : nxt + n], 80))
        back[start[t] : start[t] + n] = np.log((e[1, 0] + e[1, 1] * odds) / (e[0, 0] + e[0, 1] * odds))
    p = 1 / (1 + np.exp(-np.clip(ahead + back, -80, 80)))
    return p[packed.place], u, ahead, back


def marginals(unary: np.ndarray, links: np.ndarray, packed: Packed) -> tuple[np.ndarray, np.ndarray]:
    """P(tag = 1) of each word, and the expected counts of the four tag pairs."""
    p, u, ahead, back = forward_backward(unary, links, packed)
    pairs = np.zeros((2, 2))
    start, running = packed.start, packed.running
    for t in range(1, len(running)):
        n = running[t]
        a = np.clip(ahead[start[t - 1] : start[t - 1] + n], -80, 80)
        b = np.clip(u[start[t] : start[t] + n] + back[start[t] : start[t] + n], -80, 80)
        joint = np.stack([np.full(n, links[0, 0]), links[0, 1] + b, links[1, 0] + a, links[1, 1] + a + b])
        joint -= joint.max(0)
        np.exp(joint, out=joint)
        pairs += (joint / joint.sum(0)).sum(1).reshape(2, 2)
    return p, pairs


class _Unaries(dict):
    """Word -> its score of tag 1 over tag 0; emptied when full."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias = weights.tolist(), bias

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        got = self[word] = self.bias + sum([self.weights[k] for k in features(word)])
        return got


class Crf:
    def __init__(self) -> None:
        self.weights = np.zeros(FEATURES, np.float32)
        self.bias = -4.0
        self.links = np.zeros((2, 2))
        self.judge = np.zeros(4)
        self.prior: float | None = None
        self._unaries: _Unaries | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_unaries": None}

    def document_features(self, p: np.ndarray, packed: Packed, n: int) -> np.ndarray:
        total = np.bincount(packed.owner, p, n)
        top = np.zeros(n)
        np.maximum.at(top, packed.owner, p)
        likely = np.bincount(packed.owner, p >= 0.5, n)
        return np.stack([np.ones(n), np.log(total + 1e-3), top, np.log1p(likely)], 1)

    def score(self, many: list[list[str]]) -> tuple[np.ndarray, np.ndarray, Packed]:
        """Scores, the marginals of all words in order, and their layout."""
        packed = Packed(np.array([len(w) for w in many], np.int64))
        if self._unaries is None:
            self._unaries = _Unaries(self.weights, self.bias)
        unary = np.fromiter(map(self._unaries.__getitem__, chain.from_iterable(many)), np.float64, len(packed.owner))
        p = forward_backward(unary, self.links, packed)[0]
        if self.prior is not None:
            return np.full(len(many), self.prior), p * 0, packed
        return 1 / (1 + np.exp(-(self.document_features(p, packed, len(many)) @ self.judge))), p, packed


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.r_[0, np.ones(x.shape[1] - 1)]
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def fit(docs: list[tuple[str | None, int]], steps: int = STEPS) -> Crf:
    """docs: (text, 1 if toxic)."""
    crf = Crf()
    y = np.array([int(label) for _, label in docs], np.int64)
    if not len(y) or y.min() == y.max():
        crf.prior = float(y.mean()) if len(y) else 0.0
        return crf
    number: dict[str, int] = {}
    many = [np.fromiter((number.setdefault(w, len(number)) for w in words(t)), np.int32) for t, _ in docs]
    if not number:
        crf.prior = float(y.mean())
        return crf
    hashes, counts = array("Q"), []
    for w in number:
        own = hashed(w)
        hashes.extend(own)
        counts.append(len(own))
    n_words, counts = len(number), np.array(counts)
    del number
    of_form = np.frombuffer(hashes, np.uint64)
    form, feature = (of_form % np.uint64(FORMS)).astype(np.int32), (of_form % np.uint64(FEATURES)).astype(np.int32)
    del hashes, of_form
    first = np.cumsum(counts) - counts
    in_toxic, in_clean = np.zeros(FORMS, np.int32), np.zeros(FORMS, np.int32)
    for ws, label in zip(many, y, strict=True):
        once = np.unique(ws)
        at = np.repeat(first[once] - (np.cumsum(counts[once]) - counts[once]), counts[once]) + np.arange(counts[once].sum())
        (in_toxic if label else in_clean)[np.unique(form[at])] += 1
    n_toxic, n_clean = int(y.sum()), int(len(y) - y.sum())
    # how telling a word is: the best log-odds, toxic over clean, of its forms that three toxic documents have
    odds = np.where(in_toxic >= 3, np.log(np.maximum(in_toxic, 1) / (n_toxic + 1)) - np.log((in_clean + 1) / (n_clean + 1)), -9.0)
    telling = np.maximum.reduceat(odds[form], first)
    tags, lengths = [], []
    for ws, label in zip(many, y, strict=True):
        tag = np.zeros(len(ws), np.int8)
        if label and len(ws):
            scores = telling[ws]
            tag[scores >= max(1.5, min(2.0, scores.max()))] = 1
            if not tag.any():
                tag[scores.argmax()] = scores.max() > 0.5
        for i in range(0, len(ws), 128):  # pieces keep the fit's steps short; scoring reads whole chains
            lengths.append(len(ws[i : i + 128]))
        tags.append(tag)
    tag, word = np.concatenate(tags), np.concatenate(many)
    sizes = np.array([len(ws) for ws in many], np.int64)
    del many, tags, form, odds, telling
    packed = Packed(np.array(lengths, np.int64))
    owner = np.repeat(np.arange(n_words, dtype=np.int32), counts)
    before = packed.owner[1:] == packed.owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (tag[:-1][before], tag[1:][before]), 1)
    w, bias, links = np.zeros(FEATURES), -4.0, np.zeros((2, 2))
    mean, square = np.zeros(FEATURES + 5), np.zeros(FEATURES + 5)
    for step in range(1, steps + 1):
        unary = (np.bincount(owner, w[feature], n_words) + bias).astype(np.float32)
        p, pairs = marginals(unary[word], links, packed)
        miss = np.bincount(word, tag - p, n_words)
        grad = np.concatenate([np.bincount(feature, miss[owner], FEATURES) - 0.3 * w, [miss.sum()], (seen - pairs).ravel()])
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        change = 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        w += change[:FEATURES]
        bias += change[FEATURES]
        links += change[FEATURES + 1 :].reshape(2, 2)
    crf.weights, crf.bias, crf.links = w.astype(np.float32), float(bias), np.clip(links - links[0, 0], -8, 8)
    del packed
    whole = Packed(sizes)
    unary = (np.bincount(owner, crf.weights[feature], n_words) + crf.bias).astype(np.float32)
    p = forward_backward(unary[word], crf.links, whole)[0]
    crf.judge = _logistic(crf.document_features(p, whole, len(sizes)), y.astype(float), ridge=1.0)
    return crf


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> list[tuple[str, int]]:
    """The bounded sample to fit on, chosen by id before any text is read."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(fit_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.max(F.octet_length("text")).alias("size"), F.min(F.xxhash64("text")).alias("which"))
    room, some = fit_bytes, []
    for r in sizes.orderBy(F.xxhash64("id"), "id").collect():
        if (r["size"] or 0) <= room:
            room -= r["size"] or 0
            some.append((r.id, r.label, r.which))
    some = docs.sparkSession.createDataFrame(some, f"id {docs.schema[id_col].dataType.simpleString()}, label int, which long")
    found = rows.join(F.broadcast(some), "id").where(F.xxhash64("text") == F.col("which")).dropDuplicates(["id"])
    return [(r.text, r.label) for r in found.orderBy(F.xxhash64("id"), "id").collect()]


def tag(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", span_at: float = 0.5) -> DataFrame:
    """Per row: id, ``held_out``, ``score``, ``predicted`` and ``spans`` (start, end in code points; end exclusive)."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                source = texts(part.column(1))
                many = [words(t) for t in source]
                scores, p, packed = model.score(many)
                spans: list[list[dict]] = [[] for _ in source]
                hot = np.flatnonzero(p >= span_at)
                for doc in np.unique(packed.owner[hot]).tolist():
                    first = int(np.searchsorted(packed.owner, doc))
                    likely = p[first : first + len(many[doc])] >= span_at
                    low = source[doc].lower()
                    places = list(_WORD.finditer(low if len(low) == len(source[doc]) else source[doc]))
                    run_start = None
                    for i, yes in enumerate([*likely.tolist(), False]):
                        if yes and run_start is None:
                            run_start = i
                        if not yes and run_start is not None:
                            spans[doc].append({"start": places[run_start].start(), "end": places[i - 1].end()})
                            run_start = None
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], names=[id_col, "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, spans array<struct<start:int,end:int>>")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    return tag(docs, fit(labelled(docs, labels, id_col, text_col, label_col)), id_col, text_col)
