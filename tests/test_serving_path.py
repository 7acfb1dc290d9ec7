"""The engine with all its parts, explanations in each mode, files of mixed encodings, checks that fail hard."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import interactions as ix
from tideline.operators import policy, recall
from tideline.plans.serving import engine, requests
from tideline.sources import files
from tideline.sources.adapters import retail_impressions

SF = "/root/testdata/sf0.001"


def test_engine_with_factors_ranker_and_exclusions(spark):
    from tideline.engine import Engine

    plain = engine(spark, SF)
    als = recall.ImplicitALS(factors=4, iterations=2)
    factors = als.fit(ix.user_item(retail_impressions(spark, SF)))[1]
    e = Engine(plain.items, plain.neighbours, plain.config, factors, als, lambda rows: rows.withColumn("probability", F.col("als_score") + F.col("content_sim_profile")))
    r = requests(spark, SF).filter("request_id < 12").withColumn("exclude", F.array(F.lit(3).cast("long"), F.lit(5).cast("long")))
    found = e.candidates(r).collect()
    by = {}
    for x in found:
        by.setdefault(x.request_id, set()).add(x.source)
    gone = {x.request_id: set(x.history) | {3, 5} for x in r.collect()}
    assert all(x.item not in gone[x.request_id] or x.request_id % 5 == 1 for x in found if x.request_id % 5 != 0)
    assert not any(x.item in (3, 5) for x in found)
    for u, sources in by.items():
        want = {"search", "trending"} if u % 5 == 0 else {"content", "covisit", "trending"} if u % 5 == 1 else {"content", "covisit", "als", "channel", "trending"}
        assert sources <= want and "trending" in sources
    assert any("als" in s and "channel" in s for s in by.values())
    pages = e.recommend(r).collect()
    assert {x.mode for x in pages} >= {"search", "watch_page", "personalised"}
    for x in pages:
        assert x.reason
        if x.mode == "search" and not x.explored:
            assert x.reason.startswith(("Matches your search", "Trending in"))
        if x.mode == "watch_page":
            assert "taste profile" not in x.reason and "you watched" not in x.reason
    scored = {(x.request_id, x.item) for x in pages}
    assert len(scored) == len(pages)
    missed = spark.createDataFrame([(1, [], "qqxzzq zzqxqq")], "request_id long, history array<long>, query string")
    assert {x.source for x in e.candidates(missed).collect()} == {"trending", "popular"}


@pytest.mark.parametrize(
    ("mode", "sources", "explored", "seed", "anchor", "want"),
    [
        ("personalised", ["content", "covisit"], False, None, "A", 'People who watched "A" also watched this'),
        ("personalised", ["content"], False, None, "A", 'Because you watched "A"'),
        ("personalised", ["content"], False, None, None, "Matches what you have been watching"),
        ("personalised", ["als", "channel"], False, None, "A", "Viewers with a taste profile like yours watch this"),
        ("personalised", ["channel", "trending"], False, None, None, 'More from "ch"'),
        ("cold_start", ["popular", "trending"], False, None, None, "Trending in cat"),
        ("cold_start", [], False, None, None, "Popular in cat"),
        ("watch_page", ["als"], False, "S", "A", 'Watched by the same viewers as "S"'),
        ("watch_page", ["content"], False, "x" * 50, "A", 'Similar to "' + "x" * 41 + '…"'),
        ("watch_page", ["covisit"], False, None, "A", 'People who watched "A" also watched this'),
        ("search", ["covisit", "search"], False, None, "A", "Matches your search in cat"),
        ("search", ["trending"], False, None, None, "Trending in cat"),
        ("personalised", ["content"], True, None, "A", "Something different - picked to widen your feed"),
    ],
)
def test_explanations(spark, mode, sources, explored, seed, anchor, want):
    df = spark.createDataFrame([(mode, sources, explored, "cat", "ch", seed, anchor)], "mode string, sources array<string>, explored boolean, category string, channel string, seed string, anchor string")
    assert df.select(policy.explanation(*[F.col(c) for c in df.columns])).first()[0] == want


def test_files_of_mixed_encodings(spark, tmp_path):
    a, b, c = (tmp_path / n for n in ("a b.csv", "ü.csv", "c.csv"))
    a.write_bytes("video_id,title,views\n1,Café,5\n".encode())
    b.write_bytes("id,title,view_count\n2,Señor,6\n".encode("latin-1"))
    c.write_bytes(b"video_id,title\n3,plain\n")
    paths = [str(p) for p in (a, b, c)]
    assert list(files.encodings(spark, paths).values()) == ["UTF-8", "ISO-8859-1", "UTF-8"]
    got = {r.video_id: r.title for r in files.catalog_from_csv(spark, paths).collect()}
    assert got == {"1": "Café", "2": "Señor", "3": "plain"}


def test_sources_that_are_missing_are_passed_over_and_errors_are_not(spark, tmp_path):
    good = spark.range(3)
    df, notes = files.first_that_works([("a", lambda: spark.read.parquet(str(tmp_path / "none"))), ("b", lambda: spark.range(0)), ("c", lambda: good)])
    assert df.count() == 3 and [n.split(":")[0] for n in notes] == ["a", "b", "c"]
    with pytest.raises(ZeroDivisionError):
        files.first_that_works([("a", lambda: 1 / 0), ("c", lambda: good)])


def test_truth_fails_hard(spark):
    items = spark.createDataFrame([(1,), (2,)], "item long")
    truth = spark.createDataFrame([(1, 0.5, None), (2, 0.7, 1.0), (3, 0.1, 1.0)], "item long, quality double, other double")
    assert {(r.item, r.quality) for r in files.with_truth(items, truth, "item", ["quality"]).collect()} == {(1, 0.5), (2, 0.7)}
    for columns in (["absent"], ["other"]):
        with pytest.raises(ValueError):
            files.with_truth(items, truth, "item", columns)
    with pytest.raises(ValueError):
        files.with_truth(items.union(spark.createDataFrame([(9,)], "item long")), truth, "item", ["quality"])
    with pytest.raises(ValueError):
        files.require_fit(truth, items, "item")
    assert files.require_fit(items, items, "item") is items
