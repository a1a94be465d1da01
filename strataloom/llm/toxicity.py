"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ODD, bucket, hashed, map_arrow, mix, table

EDGE = (string.punctuation + string.digits).encode()
THRESHOLD = 0.7


@dataclass(frozen=True)
class Settings:
    """train_docs and train_chars bound the labelled sample that is gathered to fit the model."""

    train_docs: int = 10_000
    train_chars: int = 50_000_000
    bits: int = 30
    alpha: float = 6.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    min_docs: int = 3
    epochs: int = 4
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """The coordinates whose weight L1 left, ascending, with their weights; small enough to broadcast."""

    at: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct hashed unigrams, bigrams and one-word skip-grams of lower-cased words without outer punctuation."""
    found = [w for w in (x.strip(EDGE) for x in text.lower().encode().split()) if w] if text else []
    h = hashed(found)
    two = h[:-1] * ODD + h[1:] if len(h) > 1 else h[:0]
    skip = (h[:-2] * ODD + h[2:]) * ODD + np.uint64(1) if len(h) > 2 else h[:0]
    return np.unique(mix(np.concatenate([h, two, skip])) >> np.uint64(64 - bits)).astype(np.uint32)


def fit(rows: list[np.ndarray], y: np.ndarray, s: Settings) -> Model:
    """Per-coordinate adaptive rates; a coordinate stays at zero until its gradients outweigh l1.

    Coordinates met in fewer than min_docs texts could hardly do so; a table of counts drops most.
    """
    seen = np.zeros(1 << 24, np.uint16)
    low = np.uint32((1 << 24) - 1)
    for x in rows:
        k = np.unique(x & low)
        seen[k] += seen[k] < 65535
    rows = [x[seen[x & low] >= s.min_docs] for x in rows]
    names = np.unique(np.concatenate([*rows, np.zeros(0, np.uint32)]))
    z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    docs = [np.r_[np.searchsorted(names, x), len(names)].astype(np.int32) for x in rows]  # the last coordinate is the bias

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)

    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in rng.permutation(len(docs)):
            at = docs[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    live = np.flatnonzero(w[:-1])
    return Model(names[live], w[live].astype(np.float32), float(w[-1]), s.bits)


def train(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> Model:
    """Fit on at most train_docs labelled rows and train_chars characters: those of least hashed id.

    The sample of labels is bounded before it meets the documents, so it can be broadcast to them.
    A text longer than a quarter of train_chars isn't learned from, so that it can't crowd out others.
    """
    s = s or Settings()
    key = F.xxhash64(F.col("doc_id"), F.lit(s.seed))
    picked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic", key.alias("k")).orderBy("k", "toxic").limit(s.train_docs)
    joined = docs.filter(F.length("text") <= s.train_chars // 4).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    total = F.sum(F.length("text")).over(Window.orderBy("k", "toxic", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = joined.orderBy("k", "toxic", "text").limit(s.train_docs).withColumn("total", total).filter(F.col("total") <= s.train_chars).select("toxic", "text").toPandas()
    texts, y = rows.pop("text").tolist()[::-1], rows.toxic.to_numpy(float)
    found = []
    while texts:  # each text goes as its features come
        found.append(features(texts.pop(), s.bits))
    return fit(found, y, s)


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    """Probabilities; a text without words has that of the bias."""
    out = np.full(len(texts), model.bias)
    low = np.zeros(1 << 16, bool)
    low[model.at & 0xFFFF] = True
    for i, t in enumerate(texts):
        x = features(t, model.bits)
        x = x[low[x & 0xFFFF]]
        k = np.searchsorted(model.at, x)
        hit = k < len(model.at)
        hit[hit] = model.at[k[hit]] == x[hit]
        out[i] += model.weights[k[hit]].sum()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; no shuffle.

    Null and empty texts get the bias's score; repeated rows come out each; a null doc_id stays
    null; other columns are ignored; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1).to_pylist(), shared.value), pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(bucket("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
