"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes; the network reads each window in both directions, labels every byte
with a distribution over the languages, and the document's probabilities are the mean over all its bytes.  The network
is fitted with numpy on the driver by backpropagation through time (Adam), on a bounded sample: of each language the
``FIT_DOCS`` labelled documents of least id hash, so rare languages are learned too, and ``FIT_WINDOWS`` windows of each
document, spread over its whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text is read whole at any length; with
no labelled row at all every row is ``und``; rows with a null id are predicted, are not held out and never fitted on; an empty table gives
an empty result; columns that share a name with the results are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import texts

WINDOW = 48
HIDDEN = 8
FIT_DOCS = 750  # of each language
FIT_WINDOWS = 6
EPOCHS = 5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, -1, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Gru:
    """One direction.  Gates are rows: update, reset, candidate; a column for each window."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.inputs = (r.standard_normal((3 * HIDDEN, 256)) * 0.3).astype(np.float32)
        self.gates = (r.standard_normal((2 * HIDDEN, HIDDEN)) * 0.3).astype(np.float32)
        self.candidate = (r.standard_normal((HIDDEN, HIDDEN)) * 0.3).astype(np.float32)

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        a = self.inputs.take(byte, axis=1, mode="clip")
        a[: 2 * HIDDEN] += self.gates @ h
        zr = _sigmoid(a[: 2 * HIDDEN])
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        rh = r * h
        c = a[2 * HIDDEN :]
        c += self.candidate @ rh
        np.tanh(c, out=c)
        new = h + z * (c - h)
        return new, (h, z, r, rh, c)

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: bytes (time, windows); states (time, HIDDEN, windows)."""
        h = np.zeros((HIDDEN, x.shape[1]), np.float32)
        out = np.empty((len(x), HIDDEN, x.shape[1]), np.float32)
        for t, byte in enumerate(x.astype(np.intp)):
            h, saved = self.step(byte, h)
            out[t] = h
            if keep is not None:
                keep.append(saved)
        return out

    def backward(self, x: np.ndarray, keep: list, grad: np.ndarray) -> list[np.ndarray]:
        d_in = np.zeros_like(self.inputs)
        d_gates, d_cand = np.zeros_like(self.gates), np.zeros_like(self.candidate)
        dh = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, rh, c = keep[t]
            dh = dh + grad[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            d_rh = self.candidate.T @ dc
            dr = d_rh * h * r * (1 - r)
            d_cand += dc @ rh.T
            da = np.concatenate([dz, dr, dc])
            d_gates += da[: 2 * HIDDEN] @ h.T
            for k in range(3 * HIDDEN):
                d_in[k] += np.bincount(x[t], da[k], 256).astype(np.float32)
            dh = dh * (1 - z) + d_rh * r + self.gates.T @ da[: 2 * HIDDEN]
        return [d_in, d_gates, d_cand]


class Tagger:
    def __init__(self, languages: list[str]):
        self.languages = languages
        self.left, self.right = Gru(1), Gru(2)
        self.out = np.zeros((len(languages), 2 * HIDDEN), np.float32)
        self.bias = np.zeros((len(languages), 1), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.left.inputs, self.left.gates, self.left.candidate, self.right.inputs, self.right.gates, self.right.candidate, self.out, self.bias]

    def tag(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time, languages, windows) of every byte of x (time, windows)."""
        states = np.concatenate([self.left.forward(x), self.right.forward(x[::-1])[::-1]], 1)
        return self._softmax(np.matmul(self.out, states) + self.bias)

    @staticmethod
    def _softmax(a: np.ndarray) -> np.ndarray:
        a -= a.max(1, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(1, keepdims=True)
        return a

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        kept_l, kept_r = [], []
        states = np.concatenate([self.left.forward(x, kept_l), self.right.forward(x[::-1], kept_r)[::-1]], 1)
        d = self._softmax(np.matmul(self.out, states) + self.bias)
        d[:, y, np.arange(len(y))] -= 1
        d *= (mask * weight / max(1, mask.sum()))[:, None, :]
        d_states = np.matmul(self.out.T, d)
        d_out = np.einsum("tlb,tsb->ls", d, states, optimize=True)
        return [*self.left.backward(x, kept_l, d_states[:, :HIDDEN]), *self.right.backward(x[::-1], kept_r, d_states[::-1, HIDDEN:]), d_out, d.sum((0, 2))[:, None]]


def _windows(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts cut into windows: bytes and mask (WINDOW, windows), and each window's text number."""
    counts = np.array([-(-len(p) // WINDOW) for p in parts], np.int64)
    padded = b"".join(p + b"\0" * (-len(p) % WINDOW) for p in parts)
    x = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW).T
    return x, x != 0, np.repeat(np.arange(len(parts)), counts)


def fit(samples: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 5, batch: int = 512) -> Tagger:
    """samples: (language, piece of text)."""
    languages = sorted({lang for lang, _ in samples})
    model = Tagger(languages)
    if len(languages) < 2:
        return model
    number = {lang: i for i, lang in enumerate(languages)}
    parts = [text.replace("\0", " ").encode("utf-8", "replace") for _, text in samples]
    x, mask, owner = _windows(parts)
    y = np.array([number[lang] for lang, _ in samples])[owner]
    weight = (len(y) / len(languages) / np.maximum(1, np.bincount(y, minlength=len(languages)))).astype(np.float32)[y]
    rng = np.random.default_rng(seed)
    mean = [np.zeros_like(w) for w in model.weights()]
    square = [np.zeros_like(w) for w in model.weights()]
    step = 0
    epochs = max(epochs, -(-120 * batch // max(1, len(y))))  # small samples need their passes
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            at = order[i : i + batch]
            step += 1
            grads = model.gradients(np.ascontiguousarray(x[:, at]), mask[:, at], y[at], weight[at])
            for w, g, m, s in zip(model.weights(), grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return model


def predict(model: Tagger, many: list[str | None], group: int = 1024) -> tuple[list[str], list[float]]:
    read = [bool(t) and any(map(str.isalpha, t)) for t in many]
    at = [i for i, ok in enumerate(read) if ok] if model.languages else []
    label, score = ["und"] * len(many), [0.0] * len(many)
    if not at:
        return label, score
    x, mask, owner = _windows([many[i].replace("\0", " ").encode("utf-8", "replace") for i in at])
    total = np.zeros((len(at), len(model.languages)))
    for i in range(0, x.shape[1], group):
        probs = model.tag(np.ascontiguousarray(x[:, i : i + group]))
        probs *= mask[:, None, i : i + group]
        each = probs.sum(0)
        for k in range(len(model.languages)):
            total[:, k] += np.bincount(owner[i : i + group], each[k], len(at))
    total /= total.sum(1, keepdims=True)
    for row, i in enumerate(at):
        best = int(total[row].argmax())
        label[i], score[i] = model.languages[best], float(min(1.0, total[row, best]))
    return label, score


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> list[tuple[str, str]]:
    """The bounded sample to fit on: ids are chosen first, so texts of other rows are not moved, and the limit of each
    language is taken within tasks before any shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), held_out(id_col).alias("out"))
    rows = rows.where("id is not null and lang is not null and text is not null and not out")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = rows.select("id", "lang").withColumn("place", place).where(F.col("place") <= fit_docs).select("id", "lang")
    at = F.transform(F.sequence(F.lit(0), F.lit(fit_windows - 1)), lambda i: F.expr("text").substr(F.lit(1) + F.pmod(F.xxhash64("id", i), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int"), F.lit(WINDOW)))
    return [(r.lang, part) for r in rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("id", "lang", at.alias("parts")).dropDuplicates(["id", "lang"]).orderBy(F.xxhash64("id"), "lang").collect() for part in r.parts if part.strip()]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Tagger | None = None) -> DataFrame:
    """Per row: id, ``held_out``, ``lang_pred`` and ``score`` (the mean probability of that language)."""
    model = model or fit(sample(docs, id_col, text_col, lang_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                label, score = predict(sent.value, texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    tagged = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
    return tagged.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, min_score: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Tagger | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a language with that score at least; each is judged where it is read and moves
    nowhere."""
    model = model or fit(sample(docs, id_col, text_col, lang_col))
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                label, score = predict(sent.value, texts(part.column(at)))
                yield part.filter(pa.array([x != "und" and s >= min_score for x, s in zip(label, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
