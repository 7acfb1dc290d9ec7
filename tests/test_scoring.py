"""Features of pairs, cross-fitting, draws without replacement, many AUCs and expected places against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import features as ft
from tideline.operators import metrics, ranking, recall
from tideline.plans import scoring

SF = "/root/testdata/sf0.001"


def test_a_permutation_for_each_key(spark):
    for n in (1, 2, 3, 7, 100, 101, 997):
        df = spark.range(n).select("id", *[ranking.permuted(F.col("id"), F.lit(n), F.lit(k)).alias(f"k{k}") for k in (1, 2)])
        rows = df.orderBy("id").collect()
        for k in ("k1", "k2"):
            assert sorted(r[k] for r in rows) == list(range(n))
        if n >= 100:
            assert [r.k1 for r in rows] != [r.k2 for r in rows] and [r.k1 for r in rows] != list(range(n))


def test_draws_are_unseen_distinct_and_enough(spark):
    items = spark.range(0, 900, 3).select(F.col("id").alias("item"))
    seen = spark.createDataFrame([(1, 3 * i) for i in range(60)] + [(2, 0), (2, 0), (3, 99999)] + [(4, 3 * i) for i in range(295)], "request_id long, item long")
    users = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (5,)], "request_id long")
    got = {}
    for r in ranking.unseen_draws(users, seen, items, many=100).collect():
        got.setdefault(r.request_id, []).append((r.n, r.item))
    past = {}
    for r in seen.collect():
        past.setdefault(r.request_id, set()).add(r.item)
    for u in (1, 2, 3, 4, 5):
        drawn = [i for _, i in sorted(got[u])]
        assert len(drawn) == len(set(drawn)) == (5 if u == 4 else 100)
        assert not set(drawn) & past.get(u, set()) and all(i % 3 == 0 and i < 900 for i in drawn)
    assert ranking.unseen_draws(users.limit(0), seen, items).count() == 0
    assert ranking.unseen_draws(users, seen, items.limit(0)).count() == 0


def test_many_aucs_at_once(spark):
    rnd = random.Random(4)
    rows = [(f, round(rnd.gauss(y * i, 1), rnd.choice([0, 3])), y) for i, f in enumerate("abc") for y in (rnd.randrange(2) for _ in range(400))] + [("one", 1.0, 1), ("one", 2.0, 1)]
    got = {r.f: r for r in metrics.auc_by(spark.createDataFrame(rows, "f string, s double, y int"), "f", "s", "y", buckets=7).collect()}
    for f in "abc":
        pos, neg = ([s for g, s, y in rows if g == f and y == k] for k in (1, 0))
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert math.isclose(got[f].auc, want, abs_tol=1e-9) and (got[f].n_pos, got[f].n_neg) == (len(pos), len(neg))
    assert got["one"].auc is None


def test_expected_places(spark):
    rows = [(a, t) for a in range(4) for t in range(1, 5)]
    df = spark.createDataFrame(rows, "a long, t long")
    place, hits = metrics.expected_place(F.col("a"), F.col("t")), metrics.expected_hits(F.col("a"), F.col("t"), 3)
    for r in df.select("a", "t", *[c.alias(f"p_{n}") for n, c in place.items()], *[c.alias(f"h_{n}") for n, c in hits.items()]).collect():
        at = range(r.a + 1, r.a + r.t + 1)
        mean = lambda f: sum(map(f, at)) / r.t  # noqa: B023, E731
        for got, want in ((r.p_top1, mean(lambda x: x == 1)), (r.p_mrr, mean(lambda x: 1 / x)), (r.p_ndcg, mean(lambda x: 1 / math.log2(x + 1))), (r.h_hit_rate, mean(lambda x: x <= 3)), (r.h_ndcg, mean(lambda x: (x <= 3) / math.log2(x + 1))), (r.h_mean_rank, mean(lambda x: x))):
            assert math.isclose(got, want, abs_tol=1e-12)


@pytest.mark.parametrize("rows", [3, 512])
def test_similarities_and_dots_by_block(spark, rows):
    rnd = np.random.default_rng(2)
    vec = {i: v / np.linalg.norm(v) for i, v in enumerate(rnd.normal(size=(40, 6)))}
    history = [(int(u), int(i), p, 0.5**p) for u in range(9) for p, i in enumerate(rnd.integers(0, 45, rnd.integers(0, 8)))]
    pairs = sorted({(int(u), int(i)) for u, i in zip(rnd.integers(0, 12, 200), rnd.integers(0, 45, 200), strict=True)})
    h = spark.createDataFrame(history, "request_id long, item long, pos_back long, decayed double")
    p = spark.createDataFrame(pairs, "request_id long, item long")
    v = spark.createDataFrame([(i, x.tolist()) for i, x in vec.items()], "item long, v array<double>")
    got = {(r.request_id, r.item): tuple(r)[2:] for r in ft.set_similarities(h, p, v, rows=rows).collect()}
    assert set(got) == set(pairs)
    zero = np.zeros(6)
    for (u, i), (*g, anchor) in got.items():
        known = [j for q, j, _, _ in history if q == u and j in vec]
        assert anchor == (min(known, key=lambda j: (-round(float(vec[i] @ vec[j]), 6), j)) if known and i in vec else None)
        mine = [(vec.get(j, zero), w) for q, j, _, w in history if q == u]
        if not mine:
            assert g == [0, 0, 0]
            continue
        c, prof = vec.get(i, zero), sum(w * x for x, w in mine)
        n = np.linalg.norm(prof)
        assert np.allclose(g, (c @ (prof / n if n > 1e-9 else prof), c @ mine[0][0], max(c @ x for x, _ in mine)), atol=1e-9)
    q = spark.createDataFrame([(u, rnd.normal(size=6).tolist()) for u in range(7)], "request_id long, q array<double>")
    qs = {r.request_id: np.array(r.q) for r in q.collect()}
    dots = {(r.request_id, r.item): r.d for r in ft.pair_dots(p, q, v, "d", rows=rows).collect()}
    assert set(dots) == {(u, i) for u, i in pairs if u in qs and i in vec}
    assert all(math.isclose(x, qs[u] @ vec[i], abs_tol=1e-9) for (u, i), x in dots.items())


def test_no_fold_sees_its_own_users(spark):
    rows, _ = scoring.training_feeds(spark, SF)
    rows = rows.cache()
    user = rows.groupBy("user_id", "own").count().orderBy(F.desc("count"), "user_id").first()
    keyed = lambda df: df.withColumnRenamed("request_id", "session_id")
    near = lambda df: {tuple(r) for r in recall.covisitation(keyed(scoring.other_folds(df)), min_count=1).filter(F.col("fold") == user.own).collect()}
    assert near(rows) == near(rows.filter(F.col("user_id") != user.user_id))
    other = rows.filter(F.col("own") != user.own).groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first().user_id
    assert near(rows) != near(rows.filter(F.col("user_id") != other))
    als = recall.ImplicitALS(factors=3, iterations=2)
    ui = spark.createDataFrame([(u, i, 1.0, u % 4) for u in range(12) for i in range(5) if (u * 7 + i * 3) % 4], "user_id long, item long, weight double, own int")
    factors = lambda df: {(r.fold, r.id): r.y for r in als.fit_folds(scoring.other_folds(df))[1].collect()}
    a, b = factors(ui), factors(ui.filter("user_id <> 6"))
    assert all(np.allclose(a[k], b[k]) for k in a if k[0] == 6 % 4) and not all(np.allclose(a[k], b[k]) for k in a if k[0] == 1)
    alone = {r.id: r.y for r in als.fit(ui.filter("own <> 2"))[1].collect()}
    assert all(np.allclose(alone[k[1]], a[k]) for k in a if k[0] == 2)


def test_history_is_of_earlier_sessions_only(spark):
    rows, history = scoring.training_feeds(spark, SF)
    starts = {r.request_id: (r.user_id, r.start) for r in rows.groupBy("request_id", "user_id").agg(F.min("ts").alias("start")).collect()}
    clicks = [(r.user_id, r.item, r.ts) for r in rows.filter("clicked = 1").collect()]
    seen = {}
    for r in history.collect():
        seen.setdefault(r.request_id, []).append((r.pos_back, r.item))
    for request, (user, start) in starts.items():
        want = sorted(i for u, i, ts in clicks if u == user and ts < start)
        mine = [i for _, i in sorted(seen.get(request, []))]
        assert sorted(mine) == want if len(want) <= scoring.NEWEST else len(mine) == scoring.NEWEST


def test_boosting_stops_early_and_beats_single_features(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(3000, 3))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] * (x[:, 1] > 0) - 2 * x[:, 0] * (x[:, 1] <= 0))))
    y = (rnd.random(3000) < p).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t), i % 5 == 0, i % 2 == 0) for i, (r, t) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, y int, held boolean, test boolean")
    model = ranking.fit(df.filter("not test"), ["a", "b", "c"], "y", validation="held", rounds=30)
    out = model(df.filter("test")).cache()
    long = out.select("y", "a", "b", "c", F.col("probability").alias("model")).unpivot(["y"], ["a", "b", "c", "model"], "name", "s")
    aucs = metrics.auc_by(long, "name", "s", "y")
    assert ranking.gate(aucs, "model").filter("name = 'model'").first().auc > 0.75
    with pytest.raises(ValueError):
        ranking.gate(aucs, "a")
    # calibrated: mean probability near the share of positives
    m = out.agg(F.avg("probability").alias("p"), F.avg(F.col("y").cast("double")).alias("y")).first()
    assert abs(m.p - m.y) < 0.05
