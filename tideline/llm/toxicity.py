"""Toxicity from subword-bag embeddings.

A word is the mean of the embeddings of its hashed character n-grams and of itself; a text is the mean of its words; a linear softmax over ``SCALE`` times that mean gives
its probability. Embeddings and softmax are trained jointly in numpy (Adam) over whole texts. An n-gram has an embedding if it is found in ``LEAST`` training texts or more and
its share of toxic texts is off that of all by ``SIGNIFICANT`` standard deviations; the many that tell nothing would only be learned by heart. Misspelt words share most n-grams with the words they come from.
At the end a one-variable logistic curve from the softmax to the labels sets the level.

Training reads at most ``max_rows`` labelled rows, those of smallest hash, each of them whole; scoring reads every word of every text.

Null and empty texts and texts without letters score the model's prior, which is never toxic. Without labelled rows, with labels of
one kind only or without an n-gram that tells them apart, the score is the share of toxic labels (0 without any), kept below one half unless all are toxic. Repeated rows score alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.ship import ship
from tideline.llm import subwords
from tideline.llm.common import bounded_ids

LO, HI = 3, 5
BUCKETS = 1 << 18
DIMS = 4
SCALE = 100.0
LEAST, SIGNIFICANT = 3, 4.0


@dataclass
class Model:
    #: A score for each bucket: its embedding's logit difference; the softmax is linear, so means of words are means of these.
    bucket_logit: np.ndarray | None
    bias: float
    prior: float
    slope: float = 1.0
    offset: float = 0.0


def _adam(params: list[np.ndarray], grads: list[np.ndarray], state: list, step: int, rate: float) -> None:
    for p, g, s in zip(params, grads, state, strict=True):
        s[0] = 0.9 * s[0] + 0.1 * g
        s[1] = 0.99 * s[1] + 0.01 * g * g
        p -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _curve(z: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a small ridge."""
    x, beta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = _probability(x @ beta)
        gradient = x.T @ (p - y) + 1e-2 * (beta - [1.0, 0.0])
        beta = beta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), gradient)
        beta = np.clip(beta, [0.1, -40], [20, 40])
    return float(beta[0]), float(beta[1])


def _sums(of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group."""
    return np.stack([np.bincount(of, rows[:, k], minlength=n) for k in range(rows.shape[1])], 1).astype(np.float32)


def _telling(grams: np.ndarray, begins: np.ndarray, words: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Which buckets have n-grams whose share of toxic texts is off that of all texts."""
    found = np.zeros((2, BUCKETS))
    for w, y in zip(words, label, strict=True):
        found[y, np.unique(np.concatenate([grams[begins[i] : begins[i + 1]] for i in w]))] += 1
    n, toxic = len(label), int(label.sum())
    share = found.sum(0) / n
    spread = np.sqrt(share * (1 - share) * toxic * (n - toxic) / n)
    return (found.sum(0) >= LEAST) & (np.abs(found[1] - toxic * share) >= SIGNIFICANT * np.maximum(spread, 1e-9))


def train(texts: list[str], toxic: list[int], steps: int = 80, rate: float = 0.1, decay: float = 1e-6, seed: int = 7) -> Model:
    label = np.asarray(toxic, np.int64)
    prior = float(label.mean()) if len(label) else 0.0
    index: dict[str, int] = {}
    tokens = [np.fromiter((index.setdefault(w, len(index)) for w in subwords.words(t)), np.int64) for t in texts]
    filled = [d for d, x in enumerate(tokens) if len(x)]
    label = label[filled]
    if len(set(label.tolist())) < 2:
        return Model(None, 0.0, prior)
    words, times = zip(*[np.unique(tokens[d], return_counts=True) for d in filled], strict=True)
    vocabulary = list(index)
    parts = [subwords.ngrams(vocabulary[at : at + 8192], LO, HI, BUCKETS) for at in range(0, len(vocabulary), 8192)]
    grams, owner = np.concatenate([ids for ids, _ in parts]), np.concatenate([of + 8192 * i for i, (_, of) in enumerate(parts)])
    size = np.bincount(owner, minlength=len(vocabulary))
    telling = _telling(grams, np.concatenate([[0], np.cumsum(size)]), words, label)
    if not telling.any():
        return Model(None, 0.0, prior)
    kept = telling[grams]
    grams, owner = np.cumsum(telling)[grams[kept]] - 1, owner[kept]

    word = np.concatenate(words)
    text = np.repeat(np.arange(len(filled)), [len(w) for w in words])
    weight_in_text = np.concatenate([n / n.sum() for n in times]).astype(np.float32)[:, None]
    weight_in_word = (1.0 / size[owner]).astype(np.float32)[:, None]
    rng = np.random.default_rng(seed)
    n = int(telling.sum())
    table, soft, bias = (rng.normal(0, x, shape).astype(np.float32) for x, shape in ((0.1, (n, DIMS)), (0.3, (DIMS, 2)), (0.0, 2)))
    state = [[0.0, 0.0] for _ in range(3)]
    weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum()).astype(np.float32)

    def bags() -> np.ndarray:
        vectors = _sums(owner, table[grams] * weight_in_word, len(vocabulary))
        return SCALE * _sums(text, vectors[word] * weight_in_text, len(filled))

    for step in range(1, steps + 1):
        bag = bags()
        z = bag @ soft + bias
        d = weight * (_probability(z[:, 1] - z[:, 0]) - label)
        dz = np.stack([-d, d], 1).astype(np.float32)
        d_word = _sums(word, (SCALE * dz @ soft.T)[text] * weight_in_text, len(vocabulary))
        d_table = _sums(grams, d_word[owner] * weight_in_word, n)
        _adam([table, soft, bias], [d_table + decay * table, bag.T @ dz + decay * soft, dz.sum(0)], state, step, rate)
    z = bags() @ soft + bias
    slope, offset = _curve(z[:, 1] - z[:, 0], label.astype(float))
    logit = np.zeros(BUCKETS, np.float32)
    logit[telling] = SCALE * (table @ (soft[:, 1] - soft[:, 0]))
    return Model(logit, float(bias[1] - bias[0]), prior, slope, offset)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.words = subwords.WordTable(lambda new: subwords.per_word(model.bucket_logit[:, None], new, LO, HI, mean=True))

    def score(self, text: str | None) -> float:
        m = self.model
        if m.bucket_logit is None:
            return m.prior if m.prior == 1.0 else min(m.prior, 0.49)
        tokens = subwords.words(text)
        if not tokens:
            return min(m.prior, 0.49)
        self.words.room()
        at = self.words.ids(tokens)
        z = float(self.words.rows[at, 0].mean()) + m.bias
        return float(_probability(m.slope * z + m.offset))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 6000, *where: Column) -> DataFrame:
    """(__text, __y, doc_id): at most ``max_rows`` labelled rows of ``docs``, also where ids repeat; ``where`` are conditions on ``labels``."""
    ids = bounded_ids(labels.filter(F.col(label).isNotNull()), doc_id, max_rows, *where)
    known = labels.join(F.broadcast(ids), doc_id).groupBy(doc_id).agg(F.max(label).alias("__y"))
    rows = docs.select(doc_id, F.col(text).alias("__text")).join(F.broadcast(known), doc_id).select("__text", F.col("__y").cast("int").alias("__y"), doc_id)
    return rows.orderBy(F.xxhash64(F.col(doc_id).cast("string"), "__text")).limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 6000, *where: Column) -> Model:
    """Train on ``sample``. The training is one task over these rows, so neither they nor its arrays take the driver's memory, and a lost executor only repeats it."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            rows = pd.concat(parts).sort_values([doc_id, "__text"], na_position="last")
            yield pd.DataFrame({"model": [pickle.dumps(train(rows["__text"].tolist(), [int(v > 0) for v in rows["__y"]]))]})

    packed = sample(docs, labels, doc_id, text, label, max_rows, *where).coalesce(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(packed[0].model) if packed else train([], [])


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a double column ``column``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], index=texts.index, dtype="float64")

    return docs.withColumn(column, run(docs[text].cast("string")))
