"""The pipeline end to end on the smallest tables, against stages done by hand where that is exact."""

import hashlib

import corpus_pipeline as cp
from tideline.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_and_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    frames = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF).cache()
        frames.append((name, docs))
        if name != "bpe":
            assert docs.columns == cp.COLUMNS
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for _, f in frames]
    assert all(b <= a for a, b in zip([before, *ids], ids, strict=False))
    clean = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0")
    assert len({r.doc_id for r in clean.collect()} - ids[0]) <= 4
    texts = [r.text for r in frames[2][1].collect()]
    assert len(texts) == len(set(texts))
    final = frames[-1][1].collect()
    assert sorted(r.ids_sha256 for r in final) == sorted(r.ids_sha256 for r in cp.run(spark, SF).collect())
    assert all(len(r.decoded_sha256) == 64 for r in final)
    assert hashlib.sha256(b"").hexdigest() not in {r.ids_sha256 for r in final if r.n_tokens}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_nulls_repeated_rows_and_other_columns(spark):
    """Null ids, texts and languages, repeated rows and columns that a stage might use itself; other columns are not carried on."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows += [(None, "no id but a text of its own, long enough to be told apart", None, None, None), (None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", None, None, 0), rows[0], rows[0]]
    own = {c: f"'{c}' AS `{c}`" for c in ("__own", "__toxic", "score", "kept_text", "n_lines", "n_dropped", "own", "th", "made")}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *own.values())
    n = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF).cache()
        n.append(docs.count())
        if name != "bpe":
            assert docs.columns == cp.COLUMNS
            docs = docs.selectExpr("*", *own.values())
    assert n == sorted(n, reverse=True) and n[-1] > 0
    left = {r.doc_id for r in docs.collect()}
    assert None in left and left & {9001, 9002}


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 14)] == [1] * 13
