"""Columns of clashing names, small benchmarks, colliding hashes, and scores against plain passes over whole texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, language, licenses, lines, queries, simhash, subwords, toxicity

OWN = ["__own", "__e", "__l", "__id", "__th", "__th2", "__dropped", "__toxic", "own", "own_", "id", "th", "th2", "gone", "made", "id_", "th_", "row", "pos", "h", "g"]
WORDS = ["alpha", "beta", "gamma", "delta", *[f"w{i}" for i in range(40)]]


@pytest.fixture(scope="module")
def clashing(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 60))) for _ in range(24)]
    texts = [f"a shared line\n{t}" for t in texts] + [None, "", texts[0], texts[0]]
    return spark.createDataFrame([(i, t, *range(len(OWN))) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in OWN))


def keeps_columns(before, after, added=()):
    assert set(after.columns) == set(before.columns) | set(added) and len(after.columns) == len(set(after.columns))
    for r in after.select("doc_id", *OWN).collect():
        assert tuple(r)[1:] == tuple(range(len(OWN)))
    return after


def test_columns_of_any_name_stay(spark, clashing):
    items = spark.createDataFrame([(1, "beta")], "item_id long, text string")
    assert keeps_columns(clashing, simhash.keep_one(clashing)).count() == 26
    kept = keeps_columns(clashing, decontaminate.drop_contaminated(clashing, items)).collect()
    assert len(kept) == sum("beta" not in (r.text or "").split() for r in clashing.collect())
    out = keeps_columns(clashing, lines.dedup_lines(clashing), ["kept_text", "n_lines", "n_dropped"]).collect()
    assert sum(r.n_dropped for r in out) == 24
    keeps_columns(clashing, bpe.encode(clashing, queries.tokenizer_path()), ["ids", "decoded"])
    keeps_columns(clashing, licenses.scan(clashing), ["licenses"])
    model = language.train(["one two three", "un deux trois"], ["en", "fr"])
    keeps_columns(clashing, language.predict(clashing, model), ["lang_pred", "lang_score"])
    keeps_columns(clashing, toxicity.score(clashing, toxicity.train([], [])), ["score"])


def test_results_take_the_place_of_columns_of_their_name(spark):
    docs = spark.createDataFrame([(1, "one two", "x", "x", "x", "x", "x")], "doc_id long, text string, ids string, decoded string, lang_pred string, lang_score string, score string")
    assert bpe.encode(docs, queries.tokenizer_path()).first().ids != "x"
    assert language.predict(docs, None).first().lang_pred == "und" and language.predict(docs, None).first().lang_score == 0.0
    assert toxicity.score(docs, toxicity.train([], [])).first().score == 0.0
    for make in (lambda d: bpe.encode(d, queries.tokenizer_path()), lambda d: language.predict(d, None), lambda d: toxicity.score(d, toxicity.train([], [])), licenses.scan, lines.dedup_lines, simhash.keep_one):
        assert make(docs.limit(0)).count() == 0


def brute_hits(texts, items, window):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = []
    for t in texts:
        ws, hit, ids = cut(t), set(), set()
        for item_id, text in items:
            iw = cut(text)
            for i in range(max(len(iw) - window + 1, 1) if iw else 0):
                w = iw[i : i + window]
                for p in range(len(ws) - len(w) + 1):
                    if ws[p : p + len(w)] == w:
                        hit |= set(range(p, p + len(w)))
                        ids.add(item_id)
        out.append((len(ws), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 5, 20])
def test_small_benchmarks(spark, n):
    rnd = random.Random(n)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(80))) for _ in range(40)] + [None, ""]
    single = [["beta"], ["w3"], ["a", "b", "c", "q"], ["alpha"], ["gamma"], ["w4"]]
    for seed in range(3):
        items = [(f"i{k}", " ".join(single[(seed * 2 + k) % 6] if k < 2 else rnd.sample(WORDS, rnd.randrange(1, 4)))) for k in range(n)] + [("none", None), ("empty", "--")]
        docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.items) for r in decontaminate.decontaminate(docs, bench, window=3).collect())
        assert got == [(i, *x) for i, x in enumerate(brute_hits(texts, items, 3))]


def test_frequent_prefix_words_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PLACES", 3)
    texts = ["beta alpha beta", "alpha", "beta beta w1"] * 5
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([("x", "beta"), ("y", "alpha beta")], "item_id string, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.items) for r in decontaminate.decontaminate(docs, bench, window=3).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_hits(texts, [("x", "beta"), ("y", "alpha beta")], 3))]


def test_keys_of_equal_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lines, "_hash", lambda key: F.pmod(F.xxhash64(key), F.lit(3)))
    rnd = random.Random(8)
    texts = ["\n".join(rnd.choice([*WORDS[:6], *WORDS[:2], f"one{rnd.randrange(999)}"]) for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    got = {r.doc_id: r.kept_text for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    count = Counter(k for t in texts for k in set(t.split("\n")))
    assert got == {i: "\n".join(x for x in t.split("\n") if count[x] < 10) for i, t in enumerate(texts)}
    assert any(n >= 10 for n in count.values()) and any(n < 10 for n in count.values())


def test_toxicity_is_the_plain_forward_pass():
    rnd = random.Random(1)
    texts = [" ".join([*(rnd.choice(WORDS) + rnd.choice("abcdef") for _ in range(30)), *(["horrid"] * (i % 3 == 0))]) for i in range(90)]
    model = toxicity.train(texts, [int(i % 3 == 0) for i in range(90)])
    scorer = toxicity.Scorer(model)
    for t in [*texts[:6], "horridly alpha", "x" * 9999, "alpha " * 5000]:
        total = 0.0
        tokens = subwords.words(t)
        for w in tokens:
            ids, _ = subwords.ngrams([w], toxicity.LO, toxicity.HI, toxicity.BUCKETS)
            total += float(np.mean([model.bucket_logit[i] for i in ids]))
        want = 1 / (1 + np.exp(-(model.slope * (total / len(tokens) + model.bias) + model.offset)))
        assert np.isclose(scorer.score(t), want, atol=1e-6)


def test_language_is_the_plain_forward_backward():
    texts, langs = ["the river and the stone", "le fleuve et la pierre", "der fluss und der stein"] * 5, ["en", "fr", "de"] * 5
    model = language.train(texts, langs)
    tagger = language.Tagger(model)
    for t in ["the stone", "la pierre et the river", "stein"]:
        words = subwords.words(t)
        emit = np.array([sum(model.weights[i].astype(float) for i in subwords.ngrams([w], language.LO, language.HI, language.BUCKETS)[0]) for w in words])
        k = len(model.labels)
        share = np.zeros(k)
        total = 0.0
        for path in np.ndindex(*[k] * len(words)):
            p = np.exp(model.start[path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            share += p * np.bincount(path, minlength=k) / len(words)
        share /= total
        (got,) = tagger.languages([t])
        assert got[0] == model.labels[share.argmax()] and np.isclose(got[1], share.max(), atol=1e-6)


def test_many_copies_in_one_text_take_linear_time():
    text = "word " + "Released under the MIT License. " * 3000
    assert len(licenses.Scanner(licenses.TEMPLATES).scan(text)) == 3000
