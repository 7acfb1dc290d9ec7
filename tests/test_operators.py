"""Operators on tiny frames, by the invariants that the metrics and the page policy must keep."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import vectors as vec
from tideline.operators import catalog, intent, metrics, policy, ranking, recall, text


def test_clean_catalog(spark):
    rows = [("a", "Hi", 1), ("a", "later", 2), ("b", "  ", 1), ("", "x", 1), (None, "y", 1)]
    out = catalog.clean_catalog(spark.createDataFrame(rows, "id string, title string, n int"), "id", "title", "n").collect()
    assert [(r.id, r.title) for r in out] == [("a", "Hi")]


def test_coerce(spark):
    df = spark.createDataFrame([("7", None), ("bad", "x")], "views string, extra string")
    out = catalog.coerce(df, {"views": ("bigint", 0), "title": ("string", "")}).collect()
    assert [tuple(r) for r in out] == [(7, ""), (0, "")]


@pytest.mark.parametrize(("iso", "seconds"), [("PT4M13S", 253), ("P1DT2H", 93600), ("PT", 0), ("junk", 0), (None, 0)])
def test_iso_duration(spark, iso, seconds):
    assert spark.createDataFrame([(iso,)], "d string").select(catalog.iso_seconds(F.col("d"))).first()[0] == seconds


def test_tags_and_titles(spark):
    r = spark.createDataFrame([("a|b| c ", None, "x" * 50)], "t string, n string, l string")
    got = r.select(catalog.split_tags(F.col("t")), catalog.split_tags(F.col("n")), catalog.short_title(F.col("l"))).first()
    assert got[0] == ["a", "b", "c"] and got[1] == [] and len(got[2]) == 42


def lists(spark, recs, relevant):
    r = spark.createDataFrame([(1, x, k + 1) for k, x in enumerate(recs)], "user_id long, item long, rank int")
    g = spark.createDataFrame([(1, x, float(v)) for x, v in relevant.items()], "user_id long, item long, gain double")
    return r, g


def test_list_metrics(spark):
    m = metrics.list_metrics(*lists(spark, [1, 2, 3, 4, 5], {2: 1, 5: 1, 9: 1}), k=5).first()
    assert m.precision == pytest.approx(0.4) and m.recall == pytest.approx(2 / 3) and m.rr == pytest.approx(0.5) and m.hit_rate == 1
    assert m.ap == pytest.approx((1 / 2 + 2 / 5) / 3)
    graded = {10: 1.0, 20: 0.5, 30: 0.2}
    assert metrics.list_metrics(*lists(spark, [10, 20, 30], graded)).first().ndcg == pytest.approx(1.0)
    assert metrics.list_metrics(*lists(spark, [30, 20, 10], graded)).first().ndcg < 0.9
    none = metrics.list_metrics(*lists(spark, [1], {2: 1})).first()
    assert (none.precision, none.rr, none.ndcg, none.hit_rate) == (0.0, 0.0, 0.0, 0)


def test_gini(spark):
    items = spark.range(100).select(F.col("id").alias("item"))
    assert metrics.gini(items, items).first().gini == pytest.approx(0.0, abs=1e-9)
    assert metrics.gini(spark.createDataFrame([(0,)] * 50, "item long"), items).first().gini > 0.95


def test_ties_count_by_their_share(spark):
    rows = [(g, 1.0, int(i == 0)) for g in range(40) for i in range(5)]
    assert metrics.top1_share(spark.createDataFrame(rows, "g long, s double, y int"), "g", "s", "y").first().top1 == pytest.approx(0.2)
    rows = [(g, float(i == 0), int(i == 0)) for g in range(40) for i in range(4)]
    assert metrics.top1_share(spark.createDataFrame(rows, "g long, s double, y int"), "g", "s", "y").first().top1 == 1.0


def test_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, y int")
    assert metrics.auc(df, "s", "y").first().auc == pytest.approx(3.5 / 4)


def test_fusion(spark):
    c = spark.createDataFrame([(1, "a", 1, 2.0), (1, "a", 2, 1.0), (1, "b", 2, 2.0), (1, "b", 3, 1.0)], "r long, source string, item long, score double")
    top = recall.fuse(c, "r", weights={}).orderBy("rank").first()
    assert top["item"] == 2 and set(top.sources) == {"a", "b"} and top.fused == pytest.approx(1 / 62 + 1 / 61)


def blocks():
    v = np.zeros((12, 4))
    v[:6, 0] = v[6:, 1] = 1.0
    return np.linspace(1, 0, 12), v


def test_mmr():
    rel, v = blocks()
    cat, ch = np.zeros(12), np.arange(12)
    assert all(i < 6 for i in policy.select_page(rel, v, cat, ch, policy.Policy(5, 1.0, 0.0, 0))[0])
    assert any(i >= 6 for i in policy.select_page(rel, v, cat, ch, policy.Policy(5, 0.3, 0.0, 0))[0])
    picks, _ = policy.select_page(rel, v, cat, np.array([0, 1, 2] * 4), policy.Policy(6, 0.7, 0.25, 2))
    assert max(np.bincount(np.array([0, 1, 2] * 4)[picks])) == 2
    assert len(policy.select_page(rel, v, cat, np.zeros(12), policy.Policy(5, 0.7, 0.25, 2))[0]) == 5  # full caps start anew


def test_page_explores_and_keeps_length(spark):
    rel, v = blocks()
    rows = [(1, i, float(rel[i]), v[i].tolist(), i % 3, i, 1.0 + i, (i + 1) / 13) for i in range(12)]
    df = spark.createDataFrame(rows, "r long, item long, base double, v array<double>, category long, channel long, surprise double, draw double")
    page = policy.page(df, "r", policy.Policy(k=6, slots=2)).orderBy("position").collect()
    assert [p.position for p in page] == list(range(6)) and len({p["item"] for p in page}) == 6
    assert [p.position for p in page if p.explored] in ([3], [3, 4])
    shuffled = policy.page(df.orderBy(F.desc("item")).repartition(3), "r", policy.Policy(k=6, slots=2)).orderBy("position").collect()
    assert [p["item"] for p in shuffled] == [p["item"] for p in page]


def test_freshness(spark):
    r = spark.range(1).select(catalog.freshness(F.lit(0.0)), catalog.freshness(F.lit(500.0))).first()
    assert r[0] == pytest.approx(1.08) and r[1] == pytest.approx(1.0, abs=1e-4)


def test_coherence(spark):
    same = spark.createDataFrame([(1, [1.0, 0.0])] * 3 + [(2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "k long, v array<double>")
    got = {r.k: r.coherence for r in metrics.pairwise_mean_cosine(same, ["k"]).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(0.0) and got[3] == 0.0


def test_intent_label(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x"), (2, "y")], "k long, tag string")
    assert {r.k: r.label for r in intent.label(t, "k", "tag").collect()} == {1: "a", 2: "x, y"}


def test_als_solves_the_normal_equations(spark):
    rows = [(u, i, 0.2 + (u * i % 3) / 3) for u in range(8) for i in range(6) if (u + i) % 3]
    als = recall.ImplicitALS(factors=3, iterations=2)
    users, items = als.fit(spark.createDataFrame(rows, "user_id long, item long, weight double"))
    y = {r.id: np.array(r.y) for r in items.collect()}
    again = {r.id: np.array(r.y) for r in als.fold_in(spark.createDataFrame(rows, "user_id long, item long, weight double"), items).collect()}
    gram = sum(np.outer(v, v) for v in y.values())
    for u, x in again.items():
        own = [(i, w) for a, i, w in rows if a == u]
        left = gram + 0.05 * np.eye(3) + sum(30 * w * np.outer(y[i], y[i]) for i, w in own)
        assert np.allclose(left @ x, sum((1 + 30 * w) * y[i] for i, w in own), atol=1e-6)


def test_search_of_unknown_words_is_empty(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "red cat")], "id long, text string")
    index = text.postings(docs, "id", text.tokens(F.col("text")), min_df=1)
    q = spark.createDataFrame([(1, "zzz"), (2, "zzz fish")], "q long, text string")
    found = text.search(q, "q", text.tokens(F.col("text")), index, "id").collect()
    assert [(r.q, r.id) for r in found] == [(2, 1)]
    assert sum(r.w**2 for r in index.filter("id = 1").collect()) == pytest.approx(1.0)


def test_value_score_merges_or_replaces(spark):
    row = spark.createDataFrame([(1.0,) * 6], [*ranking.TASKS])
    merged, alone = row.select(ranking.value_score({"click": 2.0}), ranking.value_score({"click": 2.0}, replace=True)).first()
    assert merged == pytest.approx(sum(ranking.DEFAULT_WEIGHTS.values()) - ranking.DEFAULT_WEIGHTS["click"] + 2.0) and alone == 2.0


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(vec.l2(F.col("a")), vec.l2(F.col("z")), vec.norm(F.col("a"))).first()
    assert r[0] == [0.6, 0.8] and r[1] == [0.0, 0.0] and math.isclose(r[2], 5.0)


def test_causal_history_sees_earlier_feeds_only(spark):
    from tideline.operators.interactions import running_history

    rows = [(1, 10, "a", 100, 0, 1, 0.5), (1, 11, "a", 100, 1, 0, 0.0), (1, 12, "b", 200, 0, 1, 0.9), (1, 13, "c", 300, 0, 0, 0.0)]
    df = spark.createDataFrame(rows, "user_id long, item long, session_id string, ts long, rank_shown int, clicked int, watch_fraction double")
    assert [(r.feed_seq, r.n_history) for r in running_history(df).orderBy("feed_seq").collect()] == [(1, 0), (2, 1), (3, 2)]


def test_engine_modes_and_exclusion(spark):
    from tideline.plans.serving import engine, requests

    sf = "/root/testdata/sf0.001"
    e, r = engine(spark, sf), requests(spark, sf).filter("request_id < 6")
    page = e.recommend(r).cache()
    history = r.filter("query is null and seed is null").select("request_id", F.explode("history").alias("item"))
    from_history = page.filter(F.array_contains("sources", "content") | F.array_contains("sources", "covisit"))
    assert from_history.join(history, ["request_id", "item"], "left_semi").count() == 0
    assert page.groupBy("request_id", "item").count().filter("count > 1").isEmpty()
    assert all(0 < x["count"] <= 12 for x in page.groupBy("request_id").count().collect())
    modes = {m.request_id: m["mode"] for m in e.modes(r, e.history(r)).collect()}
    assert modes[0] == "search" and modes[1] == "watch_page" and modes[2] == "personalised"
    unknown = r.filter("request_id = 1").withColumn("seed", F.lit(10**9))
    assert e.modes(unknown, e.history(unknown)).first()["mode"] == "cold_start"


def test_config_overrides():
    from tideline.config import load

    c = load({"page.k": 7}, {"TIDELINE__RECALL__DAMPING": "0.25", "OTHER": "1"})
    assert c.page.k == 7 and c.recall.damping == 0.25 and c.factors.alpha == 30.0
    with pytest.raises(AttributeError):
        load({"nosuch.k": 1}, {})


def test_file_sources(spark, tmp_path):
    from pyspark.sql import types as T

    from tideline.sources import files

    (tmp_path / "a.csv").write_text("id,title,views,categoryId\nx,First,5,1\nx,Second,9,1\n,No id,1,2\n")
    (tmp_path / "b.csv").write_text("video_id,title,likes\ny,Third,oops\n")
    (tmp_path / "c.json").write_text('{"items": [{"id": "1", "snippet": {"title": "Music"}}]}')
    names = files.category_names(spark, str(tmp_path / "c.json"))
    got = {r.video_id: r for r in files.catalog_from_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], names).collect()}
    assert set(got) == {"x", "y"} and got["x"].title == "Second" and got["x"].category == "Music" and got["y"].like_count == 0
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.LongType()), T.StructField("v", T.StringType())])
    files.append_cache(spark.createDataFrame([("a", 1, "old")], schema), str(tmp_path / "cache"))
    files.append_cache(spark.createDataFrame([("a", 2, "new"), ("b", 1, "b")], schema), str(tmp_path / "cache"))
    assert {r.k: r.v for r in files.read_cache(spark, str(tmp_path / "cache"), schema, "k", "at").collect()} == {"a": "new", "b": "b"}
    df, notes = files.first_that_works([("none", lambda: spark.read.parquet(str(tmp_path / "nosuch"))), ("empty", lambda: spark.range(0)), ("some", lambda: spark.range(3))])
    assert df.count() == 3 and [n.split(":")[0] for n in notes] == ["none", "empty", "some"]
    (tmp_path / "r.tsv").write_text("1\t10\t5\t100\n1\t11\t2\t101\n")
    assert [r.clicked for r in files.read_ratings(spark, str(tmp_path / "r.tsv")).orderBy("item").collect()] == [1, 0]


def test_streaming_popularity_equals_batch(spark, tmp_path):
    from tideline.streaming.trending import windowed_popularity

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id * 5) AS ts, id % 3 AS item FROM range(20)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_popularity(stream).writeStream.outputMode("complete").format("memory").queryName("pop").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("pop").collect()) == sorted(windowed_popularity(rows).collect())


def test_blocked_products_against_all_pairs(spark):
    import numpy as np

    from tideline.operators import recall

    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(150, 8)), rng.normal(size=(40, 8))
    v[17] = v[3]  # a tie
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item long, v array<double>")
    queries = spark.createDataFrame([(i, x.tolist(), 1 + i % 7) for i, x in enumerate(q)], "query long, q array<double>, need int")
    from pyspark.sql import functions as F

    got = sorted((r.query, r.item) for r in recall.blocked_topk(queries, items, "query", F.col("need"), rows=16).collect())
    score = np.round(q @ v.T, 6)
    want = sorted((i, j) for i in range(40) for j in sorted(range(150), key=lambda j, i=i: (-score[i, j], j))[: 1 + i % 7])
    assert got == want
    assert recall.blocked_topk(queries.limit(0), items, "query", 3).count() == 0
    assert recall.blocked_topk(queries, items.limit(0), "query", 3).count() == 0
