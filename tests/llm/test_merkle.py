"""The Merkle manifest against plain trees: fanouts, block sizes, null and repeated rows, tampered rows."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tideline.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_root(nodes, fanout):
    """(root, for each leaf its siblings before and after at each level)."""
    at, out = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // fanout * fanout
            out[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + fanout])))
            at[i] = a // fanout
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], out


def plain(rows, fanout, tampered):
    """(doc_id, leaf, subroot, root, proof, folded) of each row."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda t: b"" if t is None else b"=" + t.encode())
    sub = {}
    for t in names:
        trees[t].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub[t] = plain_root([leaf(r) for r in trees[t]], fanout)
    root, upper = plain_root([sub[t][0] for t in names], fanout)
    out = []
    for t, up in zip(names, upper, strict=True):
        for r, low in zip(trees[t], sub[t][1], strict=True):
            at = leaf((*r[:3], r[3] + 1, r[4])) if tampered(r) else leaf(r)
            for before, after in low + up:
                at = h(before, at, after)
            out.append((r[0], leaf(r), sub[t][0], root, "".join(b + a for b, a in low + up), at))
    return sorted(out, key=str)


def table(seed, n):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, *range(n)]), rnd.choice(["s", None]), rnd.choice(["en", "en", "en", "de", "é", "日", None, ""]), rnd.choice([None, 1, 5]), rnd.choice([None, "", "a\nb", "Ünï", "x" * 9999])) for _ in range(n)]
    return rows + rows[:7] + rows[:2]


@pytest.mark.parametrize(("fanout", "block", "n"), [(2, 4096, 61), (2, 4, 61), (3, 9, 80), (5, 2, 40), (2, 4, 1)])
def test_equal_to_plain_trees(spark, monkeypatch, fanout, block, n):
    monkeypatch.setattr(merkle, "BLOCK_NODES", block)
    rows = table(n + fanout, n)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS tree", "2 AS pos", "3 AS key", "4 AS digest", "5 AS root", "6 AS size")
    tampered = lambda r: r[0] is not None and r[0] % 3 == 0 and r[3] is not None
    got = merkle.manifest(docs.repartition(3), COLUMNS, fanout=fanout, claimed={"n_chars": F.col("n_chars") + 1}, where=F.col("doc_id") % 3 == 0).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got), key=str) == plain(rows, fanout, tampered)
    assert all(r.verified == (r.folded_root == r.root) for r in got)


def test_many_trees_and_hot_key(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_NODES", 4)
    rows = [(i, "s", f"l{i % 37:02d}", 1, "t") for i in range(150)] + [(5, "s", "hot", 1, "t")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs, COLUMNS).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in got), key=str) == plain(rows, 2, lambda r: False)
    assert all(r.verified for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(docs, COLUMNS)
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "position", "size", "subroot", "root", "proof", "folded_root", "verified"]
