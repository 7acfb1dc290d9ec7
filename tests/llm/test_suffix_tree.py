"""Language-model scores against a plain suffix tree, and held-out texts."""

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import suffix_tree

AZ = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def corpus(seed, n):
    rnd = random.Random(seed)
    follows = {w: [rnd.choice("abcdefgh") for _ in range(2)] for w in "abcdefgh"}
    out = [None, "", " \n\x0b", "É e\xa0x Ab", "\x1c a"]
    for _ in range(n):
        w, text = "a", []
        for _ in range(rnd.randrange(60)):
            w = rnd.choice(follows[w]) if rnd.random() < 0.8 else rnd.choice("abcdefghXYZ") + rnd.choice(["", "", str(rnd.randrange(40))])
            text.append(w if rnd.random() < 0.8 else rnd.choice(["p q r s", "x q r t", "y q r u"]))
            w = w[0].lower() if w[0].lower() in follows else "a"
        out.append(rnd.choice([" ", "\n", "\t "]).join(text))
    return out + out[5:9]


def plain(texts, train, depth, min_count, cutoff):
    """(tokens, known, training tokens, base, score) of each text."""
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ)), None] for t in texts]
    count = Counter((w,) for ts, tr in zip(toks, train, strict=True) if tr for w in ts)
    n, v = sum(count.values()), len(count)
    root = lambda w: (count[(w,)] + 0.1) / (n + 0.1 * (v + 1))
    strength = {(): 1.0}
    grams = [count]

    def probability(context, w):
        if not context:
            return root(w)
        below = probability(context[1:], w)
        if context not in strength:
            return below
        m = strength[context]
        return (grams[len(context)][(*context, w)] + m * below) / (grams[len(context) - 1][context] + m)

    for k in range(1, depth + 1):
        pairs = Counter()
        for ts, tr in zip(toks, train, strict=True):
            for i in range(k, len(ts)):
                c = tuple(ts[i - k : i])
                if tr and grams[k - 1][c] >= min_count:
                    pairs[(*c, ts[i])] += 1
        grams.append(pairs)
        gains = {}
        for (*c, w), x in pairs.items():
            c = tuple(c)
            p = 2 ** (-round(-math.log2(probability(c[1:], w)) * suffix_tree.STEPS) / suffix_tree.STEPS)
            g = gains.setdefault(c, [0.0] * len(suffix_tree.STRENGTHS))
            for j, m in enumerate(suffix_tree.STRENGTHS):
                g[j] += x * (math.log((x - 1 + m * p) / (grams[k - 1][c] - 1 + m)) - math.log(p))
        for c, g in gains.items():
            if max(g) >= cutoff:
                strength[c] = max((x, m) for x, m in zip(g, suffix_tree.STRENGTHS, strict=True))[1]
    out = []
    for ts in toks:
        full = sum(math.log10(probability(tuple(ts[max(0, i - depth) : i]), w)) for i, w in enumerate(ts))
        out.append((len(ts), sum(count[(w,)] > 0 for w in ts), n, sum(math.log10(root(w)) for w in ts), full))
    return out, strength


@pytest.mark.parametrize(("depth", "sizes"), [(1, {}), (2, {"chunk": 300, "bucket": 200, "hot": 30}), (3, {"chunk": 100, "bucket": 5000, "hot": 1000})])
def test_equal_to_a_plain_tree(spark, depth, sizes):
    texts = corpus(depth, 150)
    train = [i % 4 != 0 for i in range(len(texts))]
    want, states = plain(texts, train, depth, 5, 3.0)
    assert any(len(c) == depth for c in states)
    rows = [(i if i % 11 else None, t, i % 4 != 0 if i % 4 else None, 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tr boolean, score double").repartition(3)
    got = suffix_tree.score(docs, F.col("tr"), depth=depth, min_count=5, **sizes).collect()
    mine = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got))
    theirs = sorted((i % 11 == 0, i if i % 11 else 0, *w[:3], round(w[3], 6), round(w[4], 6)) for i, w in enumerate(want))
    assert [m[:5] for m in mine] == [t[:5] for t in theirs]
    assert np.allclose([m[5:] for m in mine], [t[5:] for t in theirs], atol=1e-4)


def test_probabilities_of_a_state_sum_to_one():
    counts, prior = np.array([3, 0, 5, 0]), np.array([0.2, 0.3, 0.4, 0.1])
    assert math.isclose(((counts + 8 * prior) / (counts.sum() + 8)).sum(), 1)


def test_held_out_texts_gain(spark):
    texts = corpus(9, 400)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = suffix_tree.score(docs, F.col("doc_id") % 5 != 0, min_count=8).filter("doc_id % 5 = 0").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert got.s > 0.9 * got.b


def test_no_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in suffix_tree.score(docs, F.lit(False)).collect())
    assert got == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert suffix_tree.score(docs.limit(0), F.lit(True)).count() == 0
