"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability, the
logistic of the weights of its words; the document's is their noisy-or,
1 - prod(1 - p). Only documents are labelled: the gradient of the document's
likelihood is passed on to its sentences, and an L1 penalty leaves weights to
the few words that matter. The fitted weights then score sentences, which
locates the offending ones.

Words are runs of letters, digits and bytes beyond ASCII, lower-cased, and
known by a 64-bit hash. Fitted on at most SAMPLE labelled documents.

Defined cases: a null text is an empty one; a text without sentences scores
0; a null doc_id is not held out; with no labels every sentence scores the
base probability; with labels of one kind all documents and sentences score
the prior, (ones + 1/2) / (labels + 1); repeated rows are scored alike; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import LOWER, BytesHash, distinct, fold_of, flat_text, labelled, steps, table, words

#: Labelled documents that the weights are fitted on, at most.
SAMPLE = 8_000
EPOCHS, RATE, LASSO, BIAS = 120, 0.3, 1.5e-4, -6.0
#: A word counts if this many fitted documents have it.
LEAST_DOCS = 4
_HASH = BytesHash(23)
_OUTSIDE = np.array([not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128) for i in range(256)])
_STOPS = np.isin(np.arange(256), list(b".!?\n"))


def sentences(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each sentence, row of each sentence, bounds in bytes); sentences without words are left out."""
    s, e, o = words(b, offsets, _OUTSIDE)
    h = _HASH.of(LOWER[b], s, e) if len(s) else np.zeros(0, np.uint64)
    row = np.searchsorted(o, np.arange(len(s)), "right") - 1
    part = np.cumsum(_STOPS[b])[s] if len(s) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (row[1:] != row[:-1])])) if len(s) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(s)) - 1 if len(s) else first
    return h, first, row[first], np.stack([s[first], e[last]], 1) if len(s) else np.zeros((0, 2), np.int64)


@dataclass
class Weights:
    bias: float
    known: np.ndarray  # sorted hashes
    weight: np.ndarray
    prior: float | None = None  # the score of all, if labels were of one kind

    def of_sentences(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0)
        if self.prior is not None:
            return np.full(len(first), self.prior)
        w = np.zeros(len(h))
        if len(self.known):
            at = np.searchsorted(self.known, h)
            at[at == len(self.known)] = 0
            w = np.where(self.known[at] == h, self.weight[at], 0.0)
        return logistic(self.bias + np.add.reduceat(w, first))

    def of_documents(self, h: np.ndarray, first: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        return noisy_or(self.of_sentences(h, first), row, rows) if self.prior is None else np.full(rows, self.prior)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def noisy_or(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), rows))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Weights:
    """Weights from (word hashes, first word of each sentence) of each document and its label."""
    if not len(y) or not 0 < y.mean() < 1:
        prior = (float(y.sum()) + 0.5) / (len(y) + 1) if len(y) else None
        return Weights(BIAS, np.zeros(0, np.uint64), np.zeros(0), prior)
    words_ = np.concatenate([distinct(h) for h, _ in bags])
    known, docs = np.unique(words_, return_counts=True)
    known = known[docs >= LEAST_DOCS]
    if not len(known):
        return Weights(BIAS, known, np.zeros(0))
    ids, sentence, row, n = [], [], [], 0
    for r, (h, first) in enumerate(bags):
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        hit = known[at] == h
        ids.append(at[hit])
        sentence.append((np.searchsorted(first, np.flatnonzero(hit), "right") - 1) + n)
        row.append(np.full(len(first), r))
        n += len(first)
    ids, sentence, row = np.concatenate(ids), np.concatenate(sentence), np.concatenate(row)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, bias = np.zeros(len(known)), BIAS + 1
    m, v, t = np.zeros(len(known) + 1), np.zeros(len(known) + 1), 0
    for _ in range(EPOCHS):
        p = logistic(bias + np.bincount(sentence, w[ids], n))
        whole = np.clip(noisy_or(p, row, len(y)), 1e-9, 1 - 1e-9)
        # of -log likelihood, to the logit of each sentence: p for label 0, -p (1 - P) / P for label 1
        up = np.where(y == 1, -(1 - whole) / whole, 1.0) * weight
        g = up[row] * p
        grad = np.append(np.bincount(ids, g[sentence], len(known)), g.sum())
        t += 1
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        scale = RATE / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - LASSO * scale[:-1])
        bias = min(bias - step[-1], BIAS + 3)
    used = np.abs(w) > 1e-3
    return Weights(float(bias), known[used], w[used])


def train(docs: DataFrame, labels: DataFrame, *, column: str = "toxic", folds: int = 5, held_out: int = 0, most: int = SAMPLE) -> Weights:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                b, o = flat_text(batch.column(0))
                hashes, firsts = [], []
                for r in range(batch.num_rows):
                    x = b[o[r] : o[r + 1]]
                    h, first, _, _ = sentences(x, np.array([0, len(x)]))
                    hashes.append(h.tobytes())
                    firsts.append(first.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(hashes, pa.binary()), pa.array(firsts, pa.binary())], ["doc_id", "y", "words", "first"])

    rows = labelled(docs, labels, column, folds, held_out, most).select(F.col("text").cast("string"), F.col("doc_id").cast("long"), "y")
    got = rows.mapInArrow(run, "doc_id long, y int, words binary, first binary").orderBy("doc_id").collect()
    bags = [(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["first"], np.int32)) for r in got]
    return fit(bags, np.array([r["y"] for r in got], np.float64))


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id and score, the probability of label 1."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(model.value)
        with np.errstate(over="ignore"):
            for batch in batches:
                b, o = flat_text(batch.column(1))
                parts = [np.zeros(0)]
                for i, j in steps(o):
                    h, first, row, _ = sentences(b[o[i] : o[j]], o[i : j + 1] - o[i])
                    parts.append(fitted.of_documents(h, first, row, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def locate(docs: DataFrame, weights: Weights, least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, begin and end in bytes, sentence, score."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = pickle.loads(model.value)
        with np.errstate(over="ignore"):
            for batch in batches:
                b, o = flat_text(batch.column(1))
                for i, j in steps(o):
                    x = b[o[i] : o[j]]
                    h, first, row, bounds = sentences(x, o[i : j + 1] - o[i])
                    p = fitted.of_sentences(h, first)
                    at = np.flatnonzero(p >= least)
                    begin = o[i + row[at]] - o[i]
                    texts = [x[s:e].tobytes().decode("utf-8", "replace") for s, e in bounds[at].tolist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[at] + i)), pa.array(bounds[at, 0] - begin), pa.array(bounds[at, 1] - begin), pa.array(texts, pa.string()), pa.array(p[at])], ["doc_id", "begin", "end", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, begin long, end long, sentence string, score double")


def op3_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    return score(docs, weights).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
