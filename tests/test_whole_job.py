"""Queries do their whole job: nothing is cut short, and nothing is made that is not asked for."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tideline.operators import interactions as ix
from tideline.operators import recall, text
from tideline.plans import pages, scoring, serving


def test_a_history_is_all_earlier_clicks(spark):
    rows = [(1, 100 + i, f"1-{i:03d}", i * 1000, 0, 1, 0.5) for i in range(120)]
    pre = spark.createDataFrame(rows, "user_id long, item long, session_id string, ts long, rank_shown int, clicked int, watch_fraction double")
    _, history = scoring.training_feeds(spark, "", (pre, pre.limit(0)))
    last = history.filter("request_id = '1-119'")
    assert sorted(r.item for r in last.collect()) == [100 + i for i in range(119)]
    assert last.agg({"pos_back": "max"}).first()[0] == 118


def test_only_the_diagnosis_fits_models_to_compare(spark, monkeypatch):
    made, pairs = [], spark.createDataFrame([(1, 2, 1)], "request_id long, item long, clicked int")
    monkeypatch.setattr(scoring, "test_features", lambda *_, **__: pairs.drop("clicked"))
    monkeypatch.setattr(scoring, "outcomes", lambda _: pairs)
    monkeypatch.setattr(scoring, "training_features", lambda *_, **__: pairs)
    monkeypatch.setattr(scoring, "training_pair", lambda *_, **__: (pairs, pairs), raising=False)
    monkeypatch.setattr(scoring, "trained", lambda rows, kind: made.append(kind) or (lambda df: df.selectExpr("*", "0.5 as probability")))
    assert "ranker_in_sample" not in scoring.model_scores(spark, "", None).columns and made == ["gbt"]
    assert scoring.model_scores(spark, "", None, diagnosis=True).columns[-3:] == ["ranker", "ranker_in_sample", "logistic"]


def test_blocks_grow_with_the_tables():
    """Copies of both sides, in rows, at 540,000 queries and 615,000 items; blocks of 4,096 made 163 million."""
    of_query, of_items = recall._sides(540_000, 615_000, 12)
    copies = 540_000 * -(-615_000 // of_items) + 615_000 * -(-540_000 // of_query)
    assert copies < 20e6 and of_query * 64 * 8 < 20e6
    assert recall._sides(1_500, 2_000, 8) == (4096, 4096)


def test_a_sweep_tells_exposure_too(spark):
    rows = [(0, 0.5, [1, 2]), (0, 0.0, [1, 3]), (1, 0.2, [4]), (1, 0.4, [4])]
    got = {r.policy: r for r in pages.exposure(spark.createDataFrame(rows, "policy int, coherence double, items array<long>"), 5).collect()}
    for policy, counts, diversity in ((0, [0, 0, 1, 1, 2], 0.75), (1, [0, 0, 0, 0, 2], 0.7)):
        gini = 2 * sum((i + 1) * x for i, x in enumerate(counts)) / (5 * sum(counts)) - 6 / 5
        assert abs(got[policy].gini - gini) < 1e-12 and abs(got[policy].diversity - diversity) < 1e-12
        assert got[policy].coverage == sum(x > 0 for x in counts) / 5


@pytest.mark.parametrize("small", [200_000, 0])
def test_topics_are_updated_until_the_error_stands(spark, small):
    """Two kinds of documents with a word in common: two updates leave them mixed."""
    rng = np.random.default_rng(1)
    rows = [(i, f"{'ab'[i % 2]}{j}", float(rng.uniform(0.5, 1))) for i in range(30) for j in rng.choice(8, 4, replace=False)] + [(i, "common", 0.2) for i in range(30)]
    index = spark.createDataFrame(rows, "doc_id long, term string, w double")
    mixes = {r.doc_id: np.array(r.mix) for r in text.nmf(index, "doc_id", topics=2, small=small, **({} if small else {"rounds": 2})).collect()}
    assert len(mixes) == 30 and all(np.isclose(m.sum(), 1) for m in mixes.values())
    of = [np.mean([mixes[i] for i in range(k, 30, 2)], axis=0) for k in (0, 1)]
    assert of[0].argmax() != of[1].argmax() and min(of[0].max(), of[1].max()) > 0.85


def test_the_registered_topics_are_not_cut_short(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(text, "nmf", lambda index, key, topics, **more: asked.update(topics=topics, **more) or index)
    serving.nmf_topics(spark, "/root/testdata/sf0.001")
    assert asked == {"topics": 40}


@pytest.mark.parametrize("q", [0.0, 0.37, 0.8, 0.95, 1.0])
def test_the_cutoff_is_the_exact_quantile_without_gathering_times(spark, q, monkeypatch):
    """Ties, gaps, one time only, and a quantile between two ranges; ``percentile`` is not asked."""
    rng = np.random.default_rng(4)
    tables = [rng.integers(0, 10**15, 501), rng.integers(0, 5, 400), np.full(300, 7), np.array([1, 2 * 10**15]), np.concatenate([np.zeros(60), np.full(15, 10**12), rng.integers(10**14, 10**15, 25)])]
    want = [spark.createDataFrame([(int(x),) for x in t], "ts long").agg(F.floor(F.percentile("ts", q))).first()[0] for t in tables]
    monkeypatch.setattr(F, "percentile", None)
    got = [ix.cutoff(spark.createDataFrame([(int(x),) for x in t], "ts long"), q, few=8, buckets=5).first().cutoff for t in tables]
    assert got == want
    assert ix.cutoff(spark.createDataFrame([], "ts long"), q).first().cutoff is None


def test_lists_that_all_users_share_are_made_once(spark, monkeypatch):
    """Only the users' own tastes are multiplied with the items."""
    asked, plain = [], recall.blocked_topk
    monkeypatch.setattr(recall, "blocked_topk", lambda queries, *a, **b: asked.append(queries) or plain(queries, *a, **b))
    out = scoring.lists(spark, "/root/testdata/sf0.001", scoring.parts(spark, "/root/testdata/sf0.001"))
    assert len(asked) == 1
    top = [[r["item"] for r in out["popularity"].filter(F.col("request_id") == u).orderBy("rank").collect()] for u in [r[0] for r in out["popularity"].select("request_id").distinct().orderBy("request_id").limit(2).collect()]]
    assert all(len(t) == len(set(t)) == scoring.LIST for t in top)
