"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ODD, bucket, hashed, map_arrow, mix, table

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """train_docs and train_chars bound the labelled sample that is gathered to fit the model."""

    train_docs: int = 2500
    train_chars: int = 20_000_000
    buckets: int = 1 << 15
    dims: int = 16
    orders: tuple[int, ...] = (1, 2, 3)
    epochs: int = 3
    rate: float = 0.5
    calibrate: float = 0.2
    lose: float = 0.002
    floor: float = 0.4
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Each subword's logits (its embedding times the softmax weights), bias, temperature and least score."""

    labels: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    settings: Settings


def marked(word: str) -> str:
    """The runs of letters of a lower-cased word, each between < and >."""
    return "".join(f"<{run}>" for run in LETTERS.findall(word))


def subwords(found: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of marked words, flat, and each one's word; by rolling hashes in numpy."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    chars = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(found)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
    rolling, grams, owners = np.zeros(len(chars), np.uint64), [], []
    for n in range(1, max(s.orders) + 1):
        m = max(0, len(chars) - n + 1)
        rolling = rolling[:m] * ODD + mix(chars[n - 1 :])
        if n in s.orders:
            fits = left[:m] >= n
            grams.append(mix(rolling[fits] + np.uint64(n)))
            owners.append(owner[:m][fits])
    grams.append(hashed([w.encode() for w in found if w]))
    owners.append(np.flatnonzero(sizes))
    return (np.concatenate(grams) % np.uint64(s.buckets)).astype(np.int64), np.concatenate(owners)


def counted(texts: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct subword buckets and their shares."""
    out = []
    for t in texts:
        ids, _ = subwords([marked(w) for w in t.lower().split()], s)
        at, n = np.unique(ids, return_counts=True)
        out.append((at, n / max(1, n.sum())))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[str], langs: list[str], s: Settings) -> Model:
    """Stochastic gradient descent, one text a step; then temperature and least score from texts held back.

    The temperature has the least log loss on those; the least score is that below which a share of
    `lose` of their right answers falls, and never above 0.5, so clean texts are kept.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(s.seed)
    docs = counted(texts, s)
    y = np.array([labels.index(x) for x in langs], np.int64)
    use = np.array([len(d[0]) > 0 for d in docs], bool)
    order = rng.permutation(np.flatnonzero(use)) if len(docs) else np.zeros(0, np.int64)
    held = order[: int(len(order) * s.calibrate)]
    train = order[len(held) :]
    e = rng.normal(0, 1 / s.dims, (s.buckets, s.dims))
    w, b = np.zeros((s.dims, len(labels))), np.zeros(len(labels))
    steps, total = 0, max(1, s.epochs * len(train))
    for _ in range(s.epochs):
        for i in rng.permutation(train):
            at, share = docs[i]
            rate = s.rate * (1 - steps / total)
            steps += 1
            x = share @ e[at]
            g = softmax(x @ w + b)
            g[y[i]] -= 1
            back = w @ g
            w -= rate * np.outer(x, g)
            b -= 0.1 * rate * g
            e[at] -= rate * share[:, None] * back * min(len(at), 50)
    logits = e @ w
    temperature, least = 1.0, s.floor
    if len(held) >= 20 and len(labels) > 1:
        z = np.stack([docs[i][1] @ logits[docs[i][0]] + b for i in held])
        loss = {t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.25, 8, 31)}
        temperature = float(min(loss, key=loss.get))
        p = softmax(z / temperature)
        right = p.argmax(1) == y[held]
        if right.any():
            least = float(min(s.floor, np.quantile(p.max(1)[right], s.lose)))
    return Model(labels, logits.astype(np.float32), b, temperature, max(least, 1.01 / max(1, len(labels))) if len(labels) > 1 else 0.0, s)


def train(docs: DataFrame, s: Settings | None = None) -> Model:
    """Fit on at most train_docs rows and train_chars characters: those of least hash.

    Hashes alone are ranked, and the bounded list of those picked is broadcast, so no text is moved
    that isn't used. A text longer than a quarter of train_chars isn't learned from, so that it can't
    crowd out others.
    """
    s = s or Settings()
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= s.train_chars // 4)).select(F.xxhash64("doc_id", "text", F.lit(s.seed)).alias("k"), "lang", "text")
    picked = known.select("k").orderBy("k").limit(s.train_docs).distinct()
    sample = known.join(F.broadcast(picked), "k").orderBy("k", "lang").limit(s.train_docs)
    total = F.sum(F.length("text")).over(Window.orderBy("k", "lang").rowsBetween(Window.unboundedPreceding, 0))
    rows = sample.withColumn("total", total).filter(F.col("total") <= s.train_chars).select("lang", "text").toPandas()
    return fit(rows.text.tolist(), rows.lang.tolist(), s)


class Scorer:
    """Scores texts with the summed logits of each word, kept in a bounded cache."""

    limit = 300_000

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.labels) + 1), np.float32)

    def learn(self, new: list[str]) -> None:
        """Give each new word a row: its subwords' summed logits and their number."""
        m = self.model
        rows = np.zeros((len(new), len(m.labels) + 1), np.float32)
        ids, owner = subwords([marked(w) for w in new], m.settings)
        for j in range(len(m.labels)):
            rows[:, j] = np.bincount(owner, m.logits[ids, j], len(new))
        rows[:, -1] = np.bincount(owner, minlength=len(new))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.rows = np.concatenate([self.rows, rows])

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        m = self.model
        if not m.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        if len(self.at) > self.limit:
            self.clear()
        split = [t.lower().split() if t else [] for t in texts]
        self.learn(list(set().union(*split).difference(self.at)))
        sums = np.zeros((len(texts), len(m.labels) + 1))
        for i, found in enumerate(split):
            if found:
                sums[i] = self.rows[list(map(self.at.__getitem__, found))].sum(0, dtype=np.float64)
        n = sums[:, -1]
        p = softmax((sums[:, :-1] / np.maximum(n, 1)[:, None] + m.bias) / m.temperature)
        langs = [m.labels[k] if c else UNKNOWN for k, c in zip(p.argmax(1), n)]
        return langs, np.where(n > 0, p.max(1), 0.0)


_scorers: dict[int, Scorer] = {}


def identify(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The carried columns, lang_pred, score and rejected of every row; no shuffle.

    A null text or one without a letter is `und` with score 0 and rejected, as is every text if
    nothing could be learned. The model's size is fixed by its settings, so it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if id(m) not in _scorers:
            _scorers.clear()
            _scorers[id(m)] = Scorer(m)
        for b in batches:
            langs, score = _scorers[id(m)].score(b.column(len(carry)).to_pylist())
            rejected = [x == UNKNOWN or v < m.least for x, v in zip(langs, score)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [*carry, "__lang", "__score", "__rejected"])

    return map_arrow(docs.select(*(F.col(c) for c in carry), F.col("text").alias("__text")), run, ", ".join([*types, "__lang string, __score double, __rejected boolean"]))


def keep(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows of docs whose language is recognised, with their columns; fitted on docs themselves."""
    columns = docs.columns
    return identify(docs, train(docs, s), columns).filter(~F.col("__rejected")).select(*columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = bucket("doc_id", 4)
    model = train(docs.filter(fold != 2))
    found = identify(docs, model, ["doc_id"])
    return found.select("doc_id", (fold == 2).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))
