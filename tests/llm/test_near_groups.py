"""The pipeline's near-dedup groups: ids that are null or repeated, shingle similarity, and blocks shared with unrelated texts."""

import random

import numpy as np

from tideline.llm import simhash


def make(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def test_keep_one_with_null_and_repeated_ids(spark):
    rnd = random.Random(11)
    a, b, c, d, e = (" ".join(make(rnd, 60)) for _ in range(5))
    # two unrelated texts without id, one id with two unrelated texts, copies of both kinds, and a null id whose group has another
    rows = [(None, a), (None, b), (None, a), (7, c), (7, d), (7, c), (3, e), (None, e)]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (7, c), (7, d), (3, e)], key=str)


def shingle_set(text):
    return set(simhash.hashes(text, 5).tolist())


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def groups(spark, texts):
    out = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: r.component_id for r in out}


def edited(rnd, words, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"x{rnd.randrange(10**6)}"
    return out


def test_links_have_the_similarity(spark):
    rnd = random.Random(5)
    texts, below = [], 0
    for _ in range(60):
        base = make(rnd, 300)
        texts += [" ".join(base), " ".join(edited(rnd, base, 9))]  # about 0.73 to 0.79
    texts += ["word " * 300 + " ".join(make(rnd, 100)), "word " * 300 + " ".join(make(rnd, 100))]  # one shingle outweighs all others
    got = groups(spark, texts)
    for i in range(0, len(texts), 2):
        alike = jaccard(shingle_set(texts[i]), shingle_set(texts[i + 1]))
        below += alike < 0.8
        if alike < 0.8:
            assert got[i] != got[i + 1], alike
    assert below > 30


def closure(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(n):
        for i in range(j):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_blocks_shared_with_unrelated_texts_and_two_families(spark, monkeypatch):
    rnd = random.Random(6)
    one, two = make(rnd, 300), make(rnd, 300)
    # two interleaved families whose copies are like their base but seldom like each other, and unrelated texts
    texts = [" ".join(one), " ".join(two)] + [" ".join(edited(rnd, base, 6)) for _ in range(30) for base in (one, two)] + [" ".join(make(rnd, 300)) for _ in range(40)]
    monkeypatch.setattr(simhash, "block_keys", lambda m: np.ones((len(m), 1), np.int64))  # one block, over CROWD, for all
    got = groups(spark, texts)
    sets = [shingle_set(t) for t in texts]
    want = closure(len(texts), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    assert got == dict(enumerate(want))
    assert 2 <= len(set(want)) < len(texts)


def test_groups_do_not_depend_on_partitions(spark):
    rnd = random.Random(8)
    bases = [make(rnd, 200) for _ in range(12)]
    texts = [" ".join(edited(rnd, rnd.choice(bases), rnd.randrange(6))) for _ in range(150)]
    first = groups(spark, texts)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert groups(spark, texts) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    sets = [shingle_set(t) for t in texts]
    true = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    assert sum(first[i] == first[j] for i, j in true) >= 0.95 * len(true)


def test_few_shingles_empty_null_and_long_texts(spark):
    long = " ".join(make(random.Random(9), 30_000))
    texts = ["", None, "one two", "ONE  two", "a b c d e f g h i", "a b c d e f g h j", "a b c d e f g h", "b c d e f g h i", long, long + " end"]
    got = groups(spark, texts)
    assert got[0] == got[1] and got[2] == got[3] and got[8] == got[9]
    assert got[4] == got[6] == got[7]  # five shingles against four of them: 0.8
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_of_every_distance_in_crowded_blocks(spark):
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    values = {base, 0, 1, 3}
    while len(values) < 90:  # all near one value: every block is crowded
        values.add(base ^ sum(1 << b for b in rnd.sample(range(20), rnd.randrange(1, 5))))
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long").cache()
    bits = lambda i, j: bin((signed[i] ^ signed[j]) & ((1 << 64) - 1)).count("1")
    for d in range(5):
        found = {(r.a, r.b) for r in simhash.links(fps, d, block_limit=4).collect()}
        assert all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= d for a, b in found), d
        at = {v: i for i, v in enumerate(signed)}
        known = {frozenset((at[a], at[b])) for a, b in found}
        assert closure(len(signed), lambda i, j, known=known: frozenset((i, j)) in known) == closure(len(signed), lambda i, j, d=d: bits(i, j) <= d), d
