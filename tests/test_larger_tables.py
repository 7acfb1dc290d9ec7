"""Faults that only tables of several blocks or partitions show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.engine import Engine
from tideline.operators import recall, text


@pytest.fixture
def uncoalesced(spark):
    """Spark keeps every shuffle partition, as it does where tables are large."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blocks_of_both_sides_meet(uncoalesced):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 4))
    items = uncoalesced.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item long, v array<double>")
    queries = items.filter("item < 70").select(F.col("item").alias("query"), F.col("v").alias("q"))
    got = {(r["query"], r["item"]) for r in recall.blocked_topk(queries, items, "query", 5, rows=32).collect()}
    score = np.round(v[:70] @ v.T, 6)
    assert got == {(q, int(i)) for q in range(70) for i in np.argsort(-score[q], kind="stable")[:5]}


def test_channel_lists_are_the_best_of_whole_channels(uncoalesced):
    """Items of equal and of nearly equal lift, small affinities whose scores tie once rounded, and seen items."""
    rng = np.random.default_rng(5)
    items = [(i, "c%d" % (i % 3), float(q)) for i, q in enumerate(np.round(rng.gamma(2.0, size=400), 1))] + [(400 + i, "c1", 3.0 + 1e-7 * i) for i in range(40)]
    affinity = [(u, "c%d" % c, float(10.0 ** rng.uniform(-6, 1))) for u in range(30) for c in range(3) if rng.random() < 0.7] + [(30, "c0", 0.0), (31, "c9", 1.0)]
    seen = [(u, int(i)) for u in range(30) for i in rng.choice(440, rng.integers(0, 120), replace=False)]
    a = uncoalesced.createDataFrame(affinity, "user_id long, channel_id string, affinity double")
    v = uncoalesced.createDataFrame(items, "video_id long, channel_id string, q double")
    s = uncoalesced.createDataFrame(seen, "user_id long, item long")
    plain = recall.top_by(recall.channel_scores(a, v, F.col("q")).join(s, ["user_id", "item"], "left_anti"), "user_id", 7)
    rows = lambda df: sorted((r.user_id, r["rank"], r["item"], r.score) for r in df.collect())
    assert rows(recall.channel_topk(a, v, F.col("q"), s, 7)) == rows(plain)


def test_factors_do_not_depend_on_batches_and_parts(uncoalesced, monkeypatch):
    """An id whose interactions come in several parts and batches gets the same factors, and each id moves one row of sums a part."""
    rng = np.random.default_rng(8)
    rows = [(u, i, float(rng.uniform(0.01, 1))) for u in range(60) for i in range(12) if i == 0 or rng.random() < 0.4]
    ui = uncoalesced.createDataFrame(rows, "user_id long, item long, weight double")
    factors = lambda dfs: [np.array([r.y for r in df.orderBy("id").collect()]) for df in dfs]
    whole = factors(recall.ImplicitALS(4, iterations=2).fit(ui))
    dealt = recall.ImplicitALS._dealt
    monkeypatch.setattr(recall.ImplicitALS, "_dealt", staticmethod(lambda r: dealt(r, rows=7)))
    uncoalesced.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        parts = factors(recall.ImplicitALS(4, iterations=2).fit(ui))
    finally:
        uncoalesced.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(a.shape == b.shape and np.allclose(a, b, atol=1e-9) for a, b in zip(whole, parts, strict=True))


def test_sessions_are_dealt_by_their_number(spark):
    imp = spark.range(1000).select((F.col("id") % 100).alias("session_id"), F.col("id").alias("item"), F.lit(1).alias("clicked"))
    assert recall._dealt_sessions(imp, rows=100).rdd.getNumPartitions() == 10


def test_counting_terms_moves_documents_once(spark, monkeypatch):
    """Counts come from documents dealt out by key: one exchange, and it is below the words."""
    plans = []
    monkeypatch.setattr(text, "written", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    docs = spark.createDataFrame([(i, f"red blue word{i % 5}") for i in range(20)], "doc_id long, text string")
    got = text.postings(docs, "doc_id", text.tokens(F.col("text")))
    moved = [line for line in plans[0].splitlines() if "Exchange" in line]
    assert len(moved) == 1 and "doc_id" in moved[0] and "term" not in moved[0]
    assert got.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_a_text_that_many_ask_for_is_searched_once(spark, monkeypatch):
    asked = []
    plain = text.search
    monkeypatch.setattr(text, "search", lambda queries, *rest: asked.append(queries.count()) or plain(queries, *rest))
    e = Engine.__new__(Engine)
    e.index = text.postings(spark.createDataFrame([(1, "red ring"), (2, "blue ring"), (3, "red cap")], "video_id long, title string"), "video_id", text.tokens(F.col("title")), min_df=1)
    requests = spark.createDataFrame([(i, "red ring") for i in range(50)] + [(50, "cap"), (51, "qqq"), (52, None)], "request_id long, query string")
    rows = {(r.request_id, r["item"], r["rank"]) for r in e.search(requests, 2).collect()}
    assert asked == [3]
    assert {r[0] for r in rows} == set(range(51)) and all((i, 1, 1) in rows for i in range(50)) and (50, 3, 1) in rows
