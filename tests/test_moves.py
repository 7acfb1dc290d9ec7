"""How often rows move: faults that only show as time and bytes on larger tables."""

import numpy as np
from pyspark.sql import functions as F

from tideline.operators import metrics, policy, recall, text
from tideline.plans import pages, ranking, relational, scoring, serving
from tideline.plans import text as text_plans

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_impressions_move_to_their_user_once(spark):
    """Affinities and habits come from windows over the impressions: the lines are read for them and for the catalog, not once more for each history."""
    physical = plan(ranking.features(spark, D))[1]
    assert sum("FileScan" in x and "l_orderkey" in x for x in physical.splitlines()) == 2
    assert sum("Exchange hashpartitioning(user_id" in x for x in physical.splitlines()) == 1


def test_rows_are_dealt_out_in_one_move(spark):
    test = spark.range(500).select(F.col("id").alias("session_id"), (F.col("id") % 3).cast("int").alias("rank_shown"), (F.col("id") % 2).cast("int").alias("clicked"), (F.col("id") * 1.0).alias("a"), (F.col("id") % 7).alias("b"))
    dealt = serving.dealt_anew(test, ["a", "b"], buckets=4)
    assert sum("Exchange" in x for x in plan(dealt)[1].splitlines()) == 1
    rows = dealt.toPandas()
    assert sorted(rows["other_a"]) == sorted(rows["a"]) == list(np.arange(500.0)) and sorted(rows["other_b"]) == sorted(rows["b"])
    bucket = {r.session_id: r.k for r in test.select("session_id", F.pmod(F.xxhash64("session_id", "rank_shown"), F.lit(4)).alias("k")).collect()}
    assert all(bucket[int(x)] == bucket[int(y)] for x, y in zip(rows["a"], rows["other_a"], strict=True)) and (rows["a"] != rows["other_a"]).mean() > 0.9


def test_ranges_are_summed_in_one_pass(spark):
    """Scores are sorted once; what lies below a range is added to its sums, not joined to its rows."""
    df = spark.createDataFrame([("a", float(i % 97), i % 2) for i in range(400)], "f string, s double, y int")
    assert plan(metrics.auc_by(df, "f", "s", "y"))[0].count("Join") == 1


def test_sessions_are_cut_once_for_a_query(spark, monkeypatch):
    calls, plain = [], scoring.event_impressions
    monkeypatch.setattr(scoring, "event_impressions", lambda *a: calls.append(a) or plain(*a))
    assert scoring.feature_aucs(spark, D).count() == 18 and len(calls) == 1


def test_rare_terms_do_not_move(spark):
    """What the greatest buckets cannot hold is left out before terms are counted, and none of the terms sought is lost."""
    tf = spark.createDataFrame([(f"w{i}", n) for i in range(300) for n in [1] * (1 + (i < 60) * (70 - i))], "term string, n long")
    counted = lambda rows: rows.groupBy("term").agg(F.sum("n").alias("n")).filter("n > 1")
    kept = text._frequent(tf, counted, 20, buckets=1 << 16)
    best = lambda df: {r.term for r in counted(df).orderBy(F.desc("n"), "term").limit(20).collect()}
    assert best(kept) == best(tf) and kept.select("term").distinct().count() < 60
    assert text._frequent(tf, counted, 100).count() == tf.count()  # fewer pass than are sought: no bound


def test_small_vocabularies_give_the_same_space(spark):
    """Passes over documents as rows of arrays give what the joins give."""
    rng = np.random.default_rng(4)
    index = spark.createDataFrame([(i, f"t{j}", float(rng.uniform(0.1, 1))) for i in range(80) for j in rng.choice(30, 9, replace=False)], "doc_id long, term string, w double")
    small, joined = (text.svd(index, "doc_id", 5, oversample=4, small=n) for n in (20_000, 0))
    assert np.allclose(small.values, joined.values, atol=1e-8) and np.isclose(small.explained, joined.explained, atol=1e-8)
    a, b = ({r.doc_id: np.array(r.v) for r in x.vectors(index, "doc_id").collect()} for x in (small, joined))
    assert a.keys() == b.keys() and all(np.allclose(np.abs(a[k]), np.abs(b[k]), atol=1e-6) for k in a)


def test_sessions_of_an_item_are_counted_in_parts(spark):
    physical = plan(relational.item_popularity(spark, D))[1]
    assert "REPARTITION_BY_NUM" in physical and not any("Exchange hashpartitioning" in x and "session_id" in x and "item" in x for x in physical.splitlines())


def test_topics_move_one_row_a_posting(spark, monkeypatch):
    """Components are summed side by side, not as a row each."""
    plans = []
    plain = text.written
    monkeypatch.setattr(text, "written", lambda df, what: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, what))
    index = spark.createDataFrame([(i, f"t{i % 5}", 1.0) for i in range(20)], "doc_id long, term string, w double")
    assert text.nmf(index, "doc_id", topics=2, rounds=1).count() == 20
    assert not any("Generate" in p for p in plans)


def test_search_of_documents_is_search_of_their_postings(spark, monkeypatch):
    """Repeated and missing keys, missing texts, copies that tie, rare terms that move, several blocks: what the join with all postings gives."""
    rnd = np.random.default_rng(6)
    say = lambda n: " ".join(f"w{min(int(x), 60)}" for x in rnd.zipf(1.4, n))
    rows = [(i, say(int(rnd.integers(1, 30)))) for i in range(150)] + [(3, say(9)), (3, "w1 w2"), (None, say(9)), (None, "w2"), (151, None), (152, "")] + [(200 + i, "w1 w2 w7") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, say(6)) for i in range(40)] + [(40, "zzz"), (41, "zzz w7"), (42, None)], "item_id long, text string")
    words = text.tokens(F.col("text"))
    plain = recall.top_by(text.search(asked, "item_id", words, text.postings(docs, "doc_id", words), "doc_id"), "item_id", 4, item="doc_id")
    listed = lambda df: sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())
    want = listed(plain)
    for terms, postings in ((200_000, 2_000_000), (5, 2_000_000), (0, 2_000_000), (5, 0)):
        monkeypatch.setattr(text, "SENT_TERMS", terms)
        monkeypatch.setattr(text, "SENT_POSTINGS", postings)
        assert listed(text.search_documents(asked, "item_id", words, docs, "doc_id", words, 4)) == want
    monkeypatch.setattr(text, "SENT_POSTINGS", 2_000_000)
    scored = text._scored
    monkeypatch.setattr(text, "_scored", lambda *a: scored(*a, block=7, docs=16))
    assert listed(text.search_documents(asked, "item_id", words, docs, "doc_id", words, 4)) == want


def test_search_writes_no_index(spark, monkeypatch):
    """Postings of whole documents are neither written nor moved, and for unknown words nothing of them is."""
    made = []
    plain = text.written
    for module in (text, text_plans):
        monkeypatch.setattr(module, "written", lambda df, what: made.append(what) or plain(df, what))
    assert text_plans.text_search(spark, D).count() > 0 and not {"counts", "index"} & set(made)
    made.clear()
    assert text_plans.text_search_oov(spark, D).count() == 0 and made == ["asked"]


def test_pages_of_many_requests_are_those_of_each(spark):
    """Requests of unlike sizes, ties, full channels and copies, side by side and in batches that end within a request."""
    rng = np.random.default_rng(9)
    groups = [(np.sort(rng.uniform(size=n).round(1))[::-1], rng.integers(-1, 2, (n, 4)).astype(float), rng.integers(0, 3, n), rng.integers(0, 4, n)) for n in rng.integers(1, 25, 40)]
    rows = [(r, i, float(rel[i]), v[i].tolist(), int(cat[i]), int(ch[i]), 1.0, 0.5) for r, (rel, v, cat, ch) in enumerate(groups) for i in range(len(rel))]
    df = spark.createDataFrame(rows, "r long, item long, base double, v array<double>, category long, channel long, surprise double, draw double").orderBy(F.rand(3))
    ways = [policy.Policy(k=6, slots=0), policy.Policy(k=9, mmr=0.3, per_channel=0, slots=0)]
    got = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for n, p in enumerate(ways):
            for x in policy.page(df, "r", p).orderBy("r", "position").collect():
                got.setdefault((n, x.r), []).append((x["item"], x.moved))
        coherence = {(x.policy, x.r): (x.coherence, x.n) for x in policy.coherences(df, "r", ways).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == coherence.keys() == {(n, r) for n in range(2) for r in range(40)}
    for (n, r), page in got.items():
        picks, moved = policy.select_page(*groups[r], ways[n])
        assert page == list(zip(picks, moved, strict=True))
        v = groups[r][1][picks]
        pairs = [v[i] @ v[j] for i in range(len(v)) for j in range(len(v)) if i != j]
        assert np.isclose(coherence[n, r][0], np.mean(pairs) if pairs else 0.0) and coherence[n, r][1] == len(picks)


def test_policies_are_swept_in_one_pass(spark):
    """Candidates are neither kept nor moved once for each policy, nor are pages joined with vectors again."""
    physical = plan(pages.policy_sweep(spark, D))[1]
    assert "InMemoryTableScan" not in physical and sum("MapInArrow" in x for x in physical.splitlines()) == 1 and "InPandas" not in physical
    assert sum("FileScan" in x and "embedding" in x for x in physical.splitlines()) == 1
