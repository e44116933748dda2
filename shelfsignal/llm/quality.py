"""Quality scores by Bradley-Terry ranking of documents.

Features describe the form of a whole text (lengths, shares of kinds of
bytes, repetition of words, lines), no label, language, source or id. At most
``SAMPLE`` labelled documents of either label (those of the smallest hash of
doc_id) are read for learning; that many feature rows go to the driver. Pairs
of a good and a bad one, ``PAIRS`` of them drawn with a fixed seed, are the
preferences: weights are found by logistic loss on the difference of their
features (Newton's method with a ridge). The threshold is the quantile of the
training scores that leaves the share of label 1 above it that it has among all
labelled documents to be learned from, not in the sample: each label's scores
weigh as many as the label has. The score is the logistic function of the
distance to it.

Defined cases: null and empty texts have the features of an empty text, a
score like any other; without labels of both kinds all scores are 0.5; several
labels of a document all count; rows with null ids are scored, not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, maybe_broadcast, stage, tune
from .langid import held_out
from .textvec import _CHUNK, buffers, word_hashes, word_spans

SAMPLE, PAIRS, RIDGE, SEED = 20_000, 60_000, 1e-3, 11
_KINDS = [(48, 57), (65, 90), (97, 122), (128, 255), (10, 10), (124, 124), (33, 33), (35, 38), (42, 42), (44, 44), (46, 46), (63, 63), (58, 59), (34, 34), (40, 41), (45, 45), (47, 47), (60, 62), (64, 64), (95, 95)]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]).astype(float)
    shares = [per((data >= a) & (data <= z)) / np.maximum(size, 1) for a, z in _KINDS]
    start, end, bounds = word_spans(data, offsets)
    words = np.diff(bounds).astype(float)
    many = np.maximum(words, 1)
    count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]).astype(float)
    length = (end - start).astype(float)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    h = word_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    signs = ~(((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)) | (last >= 128))
    mean = count(length) / many
    rows = [*shares, np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(0, count(length**2) / many - mean**2)), distinct / many, (distinct / many) * np.log1p(words), count(again) / many, count(signs) / many, count(length == 1) / many, count(length > 20) / many, (size == 0).astype(float)]
    x = np.stack(rows, axis=1)
    return np.concatenate([x, np.sqrt(np.stack(shares, axis=1)), np.log1p(words)[:, None] ** 2 / 10], axis=1)


WIDTH = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


def _slices(column):
    data, offsets = buffers(column)
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 2 * _CHUNK, "right")) - 1)
        yield features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def _described(batches):
    for batch in batches:
        x = np.concatenate([*_slices(batch.column("text")), np.zeros((0, WIDTH))])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH, dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), lists], names=["quality", "x"])


class Model:
    """Weights over standardised features, and the threshold."""

    def __init__(self, mean, scale, weights, threshold):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights - self.threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def quantile(scores: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The middle between the scores below and above which ``share`` of the weight and the rest lie."""
    order = np.argsort(scores, kind="stable")
    below = np.cumsum(weights[order])
    at = int(np.searchsorted(below, share * below[-1] * (1 - 1e-12)))
    return float(scores[order[[at, min(at + 1, len(order) - 1)]]].mean())


def fit(x: np.ndarray, y: np.ndarray, counts: dict[int, int] | None = None) -> Model:
    """``counts``: documents of each label in all, of which ``y`` may be a sample."""
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    model = Model(mean, scale, np.zeros(WIDTH), 0.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(SEED)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(WIDTH)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (1 - p) / PAIRS - RIDGE * w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / PAIRS + RIDGE * np.eye(WIDTH), grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    counts = counts or {0: len(bad), 1: len(good)}
    weights = np.where(y == 1, counts[1] / len(good), counts[0] / len(bad))
    model.threshold = quantile(z @ w, weights, counts[0] / (counts[0] + counts[1]))
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``labels`` (doc_id, quality) that aren't held out."""
    tune(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(mod=3, rest=1)).select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    known = stage(bounded_sample(known, SAMPLE, "_id", by="quality"), "labelled")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(maybe_broadcast(known), F.col("doc_id") == F.col("_id")).select("text", "quality")
    table = rows.mapInArrow(_described, "quality int, x array<double>").toPandas()  # at most SAMPLE rows of either label
    table = table.iloc[np.lexsort(np.stack([*table["x"]], axis=1)[::-1])] if len(table) else table
    return fit(np.stack([*table["x"]]) if len(table) else np.zeros((0, WIDTH)), table["quality"].to_numpy(), counts)


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            s = np.concatenate([*(model.score(x) for x in _slices(batch.column("text"))), np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def rank(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, score double, predicted int").select("doc_id", held_out(mod=3, rest=1).alias("held_out"), "score", "predicted")
