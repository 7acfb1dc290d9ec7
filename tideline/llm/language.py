"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has a label, its language. Its features are the hashed n-grams of one to three letters with marks at the word's ends (affixes
are n-grams that touch a mark) and the word itself (a lexicon entry). Features, transitions and start weights are learned together by
maximum likelihood (Adam over forward-backward gradients, numpy). Training sequences are runs of words of labelled texts and, so
that changes of language are learned too, runs put together from pieces of texts of two languages.

A text gets the posterior of every label for every word by forward-backward; its language is the label with the largest expected share
of words, its score that share. Texts without a letter, null or empty ones are ``und`` with score 0, as is every text where nothing was learned.

Training reads a bounded sample: ``max_rows`` labelled rows, those of smallest hash, each of them whole, in runs of ``RUN`` words. It ends when the words of
the sample get their own label with a probability of ``SURE`` on average, after ``steps`` steps at the latest. It is one task, so neither rows nor arrays take the driver's memory.
Prediction reads whole texts. Repeated rows are predicted alike. Columns ``lang_pred`` and ``lang_score`` of the input are written over. An empty table has no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.ship import ship
from tideline.llm import subwords
from tideline.llm.common import bounded_ids, spare

LO, HI = 1, 3
BUCKETS = 1 << 15
RUN = 24
SURE = 0.995


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, labels)
    start: np.ndarray
    moves: np.ndarray  # (from, to)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def posteriors(emit: np.ndarray, length: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posterior (n, steps, labels) for sequences padded to the same number of steps, and the expected moves if asked for.

    Messages are scaled at each step, so they stay in range however long a text is.
    """
    n, steps, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    live = np.arange(steps)[None, :] < length[:, None]
    move = np.exp(moves - moves.max())
    alpha = np.empty_like(e)
    a = e[:, 0] * np.exp(start - start.max())
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[:, t - 1] @ move) * e[:, t]
        alpha[:, t] = np.where(live[:, t, None], a / a.sum(1, keepdims=True), alpha[:, t - 1])
    post = np.zeros_like(e)
    beta = np.ones((n, k))
    expected = np.zeros((k, k)) if pairs else None
    for t in range(steps - 1, -1, -1):
        p = alpha[:, t] * beta
        post[:, t] = np.where(live[:, t, None], p / p.sum(1, keepdims=True), 0.0)
        if t:
            back = e[:, t] * beta
            if pairs:
                joint = alpha[:, t - 1, :, None] * move[None] * back[:, None, :]
                expected += np.where(live[:, t, None, None], joint / joint.sum((1, 2), keepdims=True), 0.0).sum(0)
            b = back @ move.T
            beta = np.where(live[:, t, None], b / b.sum(1, keepdims=True), beta)
    return post, expected


def train(texts: list[str], langs: list[str], steps: int = 40, seed: int = 11) -> Crf | None:
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    pieces: list[tuple[list[str], int]] = []
    for text, lang in zip(texts, langs, strict=True):
        w = subwords.words(text)
        pieces += [(w[at : at + RUN], labels.index(lang)) for at in range(0, len(w), RUN)]
    if not pieces:
        return None
    seqs = [(w, [y] * len(w)) for w, y in pieces]
    for i in rng.permutation(len(pieces))[: len(pieces) // 2]:
        (w, y), (v, z) = pieces[i], pieces[rng.integers(len(pieces))]
        a, b = rng.integers(1, RUN, 2)
        seqs.append((w[:a] + v[:b], [y] * len(w[:a]) + [z] * len(v[:b])))
    length = np.array([len(w) for w, _ in seqs])
    live = np.arange(length.max())[None, :] < length[:, None]
    vocabulary, flat = np.unique([x for w, _ in seqs for x in w], return_inverse=True)
    gold = np.array([y for _, ys in seqs for y in ys])
    ids, owner = subwords.ngrams(vocabulary.tolist(), LO, HI, BUCKETS)
    k = len(labels)
    weights, start, moves = np.zeros((BUCKETS, k)), np.zeros(k), np.zeros((k, k))
    gold_hot = np.eye(k)[gold]
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    gold_start = gold_hot[first].sum(0)
    inner = np.ones(len(gold), bool)
    inner[first] = False
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    params, state = [weights, start, moves], [[0.0, 0.0] for _ in range(3)]
    for step in range(1, steps + 1):
        emit_word = np.stack([np.bincount(owner, weights[ids, j], minlength=len(vocabulary)) for j in range(k)], 1)
        emit = np.zeros((len(seqs), live.shape[1], k))
        emit[live] = emit_word[flat]
        post, expected = posteriors(emit, length, start, moves, pairs=True)
        d = post[live] - gold_hot
        if 1 + d[np.arange(len(gold)), gold].mean() > SURE:
            break
        d_word = np.stack([np.bincount(flat, d[:, j], minlength=len(vocabulary)) for j in range(k)], 1)
        d_weights = np.stack([np.bincount(ids, d_word[owner, j], minlength=BUCKETS) for j in range(k)], 1)
        grads = [d_weights / len(seqs) + 1e-4 * weights, (post[:, 0].sum(0) - gold_start) / len(seqs) + 1e-4 * start, (expected - gold_moves) / len(seqs) + 1e-4 * moves]
        for p, g, s in zip(params, grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            p -= 0.1 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return Crf(labels, weights.astype(np.float32), start, moves)


def _has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


class Tagger:
    def __init__(self, model: Crf):
        self.model = model
        self.table = subwords.WordTable(lambda new: subwords.per_word(model.weights, new, LO, HI, mean=False))

    def tag(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, language, posterior) for each word of one text."""
        tokens = subwords.words(text)
        if not any(map(_has_letter, tokens)):
            return []
        at = self.table.ids(tokens)
        post, _ = posteriors(self.table.rows[at][None], np.array([len(tokens)]), self.model.start, self.model.moves)
        best = post[0].argmax(1)
        return [(w, self.model.labels[b], float(post[0, i, b])) for i, (w, b) in enumerate(zip(tokens, best, strict=True))]

    def languages(self, texts: list[str | None], cells: int = 400_000) -> list[tuple[str, float]]:
        """(language, score) of each text. Texts of like length go through the chain together, at most ``cells`` words with padding."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        self.table.room()
        rows = []
        for i, text in enumerate(texts):
            tokens = subwords.words(text)
            if any(map(_has_letter, tokens)):  # figures such as one half are no letters
                rows.append((i, self.table.ids(tokens)))
        rows.sort(key=lambda r: len(r[1]))
        while rows:
            many = max(1, min(len(rows), 512, cells // len(rows[-1][1])))
            group, rows = rows[-many:], rows[:-many]
            length = np.array([len(r[1]) for r in group])
            live = np.arange(length.max())[None, :] < length[:, None]
            emit = np.zeros((*live.shape, len(self.model.labels)))
            emit[live] = self.table.rows[np.concatenate([r[1] for r in group])]
            share = posteriors(emit, length, self.model.start, self.model.moves)[0].sum(1) / length[:, None]
            for (i, _), s in zip(group, share, strict=True):
                b = int(s.argmax())
                out[i] = (self.model.labels[b], float(min(max(s[b], 0.0), 1.0)))
        return out


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 600, *where: Column) -> DataFrame:
    """At most ``max_rows`` rows with a label and a text, also where ids repeat."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = bounded_ids(known, doc_id, max_rows, *where)
    rows = known.join(F.broadcast(ids), doc_id).select(doc_id, F.col(text).alias("text"), F.col(lang).alias("lang"))
    return rows.orderBy(F.xxhash64(F.col(doc_id).cast("string"), "text", "lang")).limit(max_rows)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 600, *where: Column) -> Crf | None:
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            rows = pd.concat(parts).sort_values(["doc_id", "text", "lang"])
            yield pd.DataFrame({"model": [pickle.dumps(train(rows["text"].tolist(), rows["lang"].tolist()))]})

    rows = sample(docs, doc_id, text, lang, max_rows, *where).select(F.col(doc_id).alias("doc_id"), "text", "lang")
    packed = rows.coalesce(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(packed[0].model) if packed else None


def predict(docs: DataFrame, model: Crf | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value) if shared.value else None
        for texts in batches:
            found = []
            for at in range(0, len(texts), 2048):
                part = texts.iloc[at : at + 2048].tolist()
                found += tagger.languages(part) if tagger else [("und", 0.0)] * len(part)
            yield pd.DataFrame(found, columns=["lang", "score"], index=texts.index)

    (made,) = spare(docs, "made")
    return docs.withColumn(made, run(docs[text].cast("string"))).withColumns({"lang_pred": F.col(made)["lang"], "lang_score": F.col(made)["score"]}).drop(made)
