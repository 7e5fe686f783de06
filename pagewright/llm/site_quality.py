"""Quality of documents by hierarchical empirical Bayes over documents, hosts and paths.

A logistic classifier over statistics of the text (fitted in numpy on at most ``FIT_DOCS`` labelled documents of least id
hash) gives each document's own evidence.  Labels are grouped by host and by path below the host; the between-group
variance, estimated by moments from grouped sums, sets the strength of a beta prior, so a host with few labels shrinks to
the global rate and a path with few labels to its host.  A labelled document's own label is left out of the sums that
judge it.  The log-odds of the document move by the log-odds of its path's posterior against the global rate.

Defined cases: a null or empty text is scored from its zero statistics; a source without a label gets the prior; a null
source is the host ''; a source ``host/path...`` is split at its first slash, and all behind it is the path; an id with
several labels counts with their mean; repeated rows count as often as they occur; columns that share a name with the
results are not read; texts of any length are read whole; without labels, or with one kind only, the classifier is the constant share; a null id is scored; an empty table
gives an empty result.

Plan: labels meet only the documents' ids and sources.  Sums by path and host are pre-aggregated; the site table is sent
to the tasks up to ``BROADCAST_SITES`` rows and joined by shuffle beyond.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import checkpointed, texts

FIT_DOCS = 6000
BROADCAST_SITES = 100_000
_MARKS = "#*$%&|<>!?.,;:@=_/\\\"'()[]{}-+~^"
_NAMES = 17 + len(_MARKS)


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, none of which grows without bound with its length."""
    t = text or ""
    words = t.split()
    n, chars = max(1, len(words)), max(1, len(t))
    counts = Counter(words)
    lines = [x for x in t.split("\n") if x.strip()]
    lengths = list(map(len, words))
    top = counts.most_common(1)[0][1] if counts else 0
    letters, digits, upper = len(re.findall(r"[^\W\d_]", t)), len(re.findall(r"\d", t)), len(re.findall(r"[A-Z]", t))
    return [
        np.log1p(len(words)), np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), len(counts) / n, np.log1p(n) * len(counts) / n,
        sum(lengths) / n, max(lengths, default=0) ** 0.5, top / n, letters / chars, digits / chars, upper / chars, len(words) / chars,
        sum(not any(map(str.isalpha, w)) for w in counts) / max(1, len(counts)), sum(w[-1] in ".!?" for w in words) / n,
        float(len(words) < 10), float(len(words) < 50), sum(len(w) == 1 for w in words) / n,
        *(min(1.0, 20 * t.count(c) / chars) for c in _MARKS),
    ]


class Classifier:
    def __init__(self, rows: list[list[float]], labels: list[float]):
        y = np.array(labels)
        self.rate = float(y.mean()) if len(y) else 0.5
        self.weights, self.mean, self.scale = None, None, None
        if len(y) and y.min() < y.max():
            x = np.array(rows)
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
            x = np.c_[np.ones(len(y)), self._fold(x)]
            w = np.zeros(x.shape[1])
            penalty = np.r_[1e-6, np.full(x.shape[1] - 1, 1.0)]
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
                w += step
                if abs(step).max() < 1e-8:
                    break
            self.weights = w

    def _fold(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[z, z * z]

    def probability(self, rows: list[list[float]]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), self.rate)
        x = self._fold(np.array(rows).reshape(len(rows), -1))
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(rows)), x] @ self.weights, -30, 30)))


def _site(source_col: str) -> list:
    source = F.coalesce(F.col(source_col), F.lit(""))
    return [F.substring_index(source, "/", 1).alias("host"), F.when(F.instr(source, "/") > 0, F.expr(f"substring(`{source_col}`, instr(`{source_col}`, '/') + 1)")).otherwise("").alias("path")]


def _strength(groups: DataFrame, own: str, above: str) -> float:
    """Prior strength of groups (n, s and the rate above them) by moments: how many labels the rate above is worth."""
    r = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col(own) - F.col(above)) ** 2).alias("spread"),
        F.sum(F.col("n") * F.col(above) * (1 - F.col(above))).alias("noise"), F.sum(F.col("n") * F.col("n")).alias("squares"),
    ).first()
    if not r.n or r.k < 2 or not r.noise:
        return 1000.0
    rate = r.noise / r.n  # mean of the binomial variances
    between = (r.spread - r.k * rate) / max(1e-9, r.n - r.squares / r.n)
    return float(np.clip(rate / between - 1, 1.0, 1000.0)) if between > 0 else 1000.0


def site_sums(labelled: DataFrame) -> tuple[DataFrame, DataFrame, tuple[float, float, float]]:
    """Of rows (host, path, label): label sums by path (host, path, n, s) and by host (host, host_n, host_s), and the
    global rate with the prior strengths of hosts and of paths."""
    paths = checkpointed(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("label").alias("s")))
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    rate = float((total.s + 1) / (total.n + 2)) if total.n else 0.5
    k_host = _strength(hosts.select(F.col("host_n").alias("n"), (F.col("host_s") / F.col("host_n")).alias("own"), F.lit(rate).alias("above")), "own", "above")
    above = (F.col("host_s") + k_host * rate) / (F.col("host_n") + k_host)
    below = paths.join(hosts, "host").select("n", (F.col("s") / F.col("n")).alias("own"), above.alias("above"))
    return paths, hosts, (rate, k_host, _strength(below, "own", "above"))


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", label_col: str = "quality",
    fit_docs: int = FIT_DOCS, keep_at: float = 0.5,
) -> DataFrame:
    """Per row: id, ``doc_evidence``, ``site_rate``, ``score`` and ``kept``."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(fit_docs)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "label")
    fitted = sample.mapInArrow(measure, "x array<double>, label double").orderBy(F.xxhash64("x")).limit(fit_docs).collect()
    model = spark.sparkContext.broadcast(Classifier([r.x for r in fitted], [round(r.label) for r in fitted]))
    paths, hosts, (rate, k_host, k_path) = site_sums(docs.select(F.col(id_col).alias("id"), *_site(source_col)).join(known, "id"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.probability([statistics(t) for t in texts(batch.column(3))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p, pa.float64())], names=[id_col, "host", "path", "doc_evidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col), *_site(source_col), F.col(text_col)).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, doc_evidence double")
    if paths.count() <= BROADCAST_SITES:
        paths, hosts = F.broadcast(paths), F.broadcast(hosts)
    joined = scored.join(hosts, "host", "left").join(paths, ["host", "path"], "left").join(known.withColumnRenamed("id", id_col), id_col, "left")
    # a labelled document is judged by its site's other labels
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    own_n, own_s = F.col("label").isNotNull().cast("int"), zero("label")
    host = (zero("host_s") - own_s + k_host * rate) / (zero("host_n") - own_n + k_host)
    site = (zero("s") - own_s + k_path * host) / (zero("n") - own_n + k_path)

    def logit(c):
        c = F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.log(c / (1 - c))

    score = 1 / (1 + F.exp(-(logit(F.col("doc_evidence")) + logit(site) - logit(F.lit(rate)))))
    return joined.select(id_col, "doc_evidence", site.alias("site_rate"), score.alias("score"), (score >= keep_at).alias("kept"))
