"""Licences planted in random text, archives with null and repeated keys, and bounded samples of repeated ids."""

import hashlib
import random
from itertools import combinations

import duckdb
import pytest

from tideline.llm import language, licenses, queries, toxicity, warc


def lis(pairs):
    for n in range(len(pairs), 0, -1):
        if any(all(a[1] < b[1] for a, b in zip(c, c[1:], strict=False)) for c in combinations(pairs, n)):
            return n
    return 0


def test_longest_rising_subsequence():
    rnd = random.Random(4)
    for _ in range(200):
        n = rnd.randrange(8)
        pairs = list(enumerate(rnd.sample(range(20), n)))
        got = licenses._rising(pairs)
        assert len(got) == lis(pairs) and got == sorted(got) and [b for _, b in got] == sorted(b for _, b in got)


@pytest.mark.parametrize("order", [("a", "the"), ("the", "a")])
def test_a_copy_is_found_beside_an_edited_one(order):
    text = " ".join(f"Released under {w} MIT License." for w in order)
    found = [f for f in licenses.Scanner(licenses.TEMPLATES).scan(text) if f[0] == "MIT-notice"]
    assert sorted(f[1] for f in found) == [0.8, 1.0]


@pytest.mark.parametrize("seed", range(6))
def test_planted_copies_are_all_found(seed):
    rnd = random.Random(seed)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    common = ["the", "of", "to", "license", "under", "and", "version"]
    text, planted = [], []
    for _ in range(12):
        text += [rnd.choice([*common, f"w{rnd.randrange(99)}"]) for _ in range(rnd.choice([0, 3, 40]))]
        name = rnd.choice(["MIT-notice", "ISC", "MPL-2.0-notice", "MIT", "BSD-2-Clause"])
        copy = licenses.words(licenses.TEMPLATES[name])
        for i in rnd.sample(range(len(copy)), int(0.1 * len(copy))):
            copy[i] = f"e{rnd.randrange(99)}"
        planted.append((name, len(text), len(text) + len(copy) - 1))
        text += copy
    found = scanner.scan(" ".join(text))
    for name, lo, hi in planted:
        assert any(f[0] == name and f[2] <= hi and lo <= f[3] and f[3] - f[2] <= 1.5 * (hi - lo + 1) for f in found), (name, lo, hi)
    for name in {f[0] for f in found}:
        spans = sorted(f[2:] for f in found if f[0] == name)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_licence_edges(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (4, "word " * 50_000 + licenses.TEMPLATES["ISC"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS licenses")
    got = sorted((r.doc_id, [x.license for x in r.licenses]) for r in licenses.scan(df).collect())
    assert got == [(1, []), (2, []), (3, ["MIT-notice"]), (3, ["MIT-notice"]), (4, ["ISC"])]
    assert licenses.scan(df.limit(0)).count() == 0


def test_archive_of_null_and_repeated_keys(spark, tmp_path):
    big, other = "x" * 1500, "y" * 1500
    rows = [(None, "http://n/", big), (7, "http://a/", big), (7, "http://b/", big), (3, None, big), (None, None, other), (None, "http://o/ o", other), (9, "http://s/", "small"), (10, "http://s/", "small"), (11, None, None), ((1 << 53) + 1, "u", "z" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS payload_bytes")
    got = warc.archive(df).collect()
    assert len(got) == len(rows)
    digest = hashlib.sha1(big.encode()).hexdigest()
    of_big = [(r.record_type, r.key, r.refers_to) for r in got if r.payload_digest == digest]
    assert sorted(of_big, key=str) == sorted([("response", 7, None), ("revisit", 7, 7), ("revisit", 3, 7), ("revisit", None, 7)], key=str)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({queries.OP5_SQL})").fetchall()
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op5_warc(spark, str(tmp_path)).collect()]
    assert sorted(mine, key=str) == sorted(want, key=str)


def test_samples_bound_rows_of_repeated_ids(spark):
    docs = spark.range(300).selectExpr("1L AS doc_id", "concat('some words number ', id) AS text", "'en' AS lang")
    assert language.sample(docs, max_rows=20).count() == 20
    assert toxicity.sample(docs, docs.selectExpr("doc_id", "1 AS toxic"), max_rows=20).count() == 20
