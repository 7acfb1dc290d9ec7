"""Tokenizer alignment against plain loops over the libraries' own encodings."""

import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tideline.llm import align, queries
from tideline.llm.bpe import byte_letters

A, B = (queries.tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [None, "", " ", "\n", "  two  spaces ", "a▁b", "<|endoftext|> and <s> </s> <unk> <0x41>", "ﬁne ½ Å", "日本語のテキスト", "😀 family 👨‍👩‍👧 café café", "tab\tnew\r\nline\x00end", "\xa0nbsp　wide", "don't we'll I'm 12345", "x" * 5000, "۱۲۳ ㊗️ ​ zero"]


def texts(seed, n=60):
    rnd = random.Random(seed)
    parts = ["the", "of", "tokenizer", "Über", "naïve", "123", "日本", "\n", ",", "ing", "<s>", "😀", "é"]
    return ODD + ["".join(rnd.choice([" ", "", " "]) + rnd.choice(parts) for _ in range(rnd.randrange(1, 80))) for _ in range(n)]


def brute(all_texts):
    hf = Tokenizer.from_file(A)
    hf.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {x: b for b, x in enumerate(byte_letters())}
    out, count = [], Counter()
    for t in all_texts:
        a = b = []
        if t:
            a, b = hf.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            raw_a = [bytes(letters[c] for c in hf.id_to_token(i)) for i in a]
            raw_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
            if not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
                a = b = []
        groups, links = [], []
        if a:
            end_a, end_b = [np.cumsum([len(x) for x in r]).tolist() for r in (raw_a, raw_b)]
            lo = 0
            for cut in sorted(set(end_a) & set(end_b)):
                groups.append(",".join(str(i) for i, e in zip(a, end_a, strict=True) if lo < e <= cut) + "|" + ",".join(str(i) for i, e in zip(b, end_b, strict=True) if lo < e <= cut))
                lo = cut
            links = [(i, j) for i, e in zip(a, end_a, strict=True) for j, f in zip(b, end_b, strict=True) if e == f]
        count.update(links)
        out.append((len(a), len(b), len(groups), ";".join(groups), links))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(na, nb, ng, g, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls)) for na, nb, ng, g, ls in out]


@pytest.mark.parametrize("chunk", [3, 400_000])
def test_equal_to_plain_loops(spark, tmp_path, chunk):
    all_texts = texts(chunk)
    all_texts += all_texts[20:24]
    docs = spark.createDataFrame([(i if i % 9 else None, t, i) for i, t in enumerate(all_texts)], "doc_id long, text string, n_a int").repartition(3)
    align.align(docs, A, B, at_once=500, chunk_links=chunk).write.parquet(str(tmp_path / "a"))
    got = align.counted(spark.read.parquet(str(tmp_path / "a"))).collect()
    want = [(i if i % 9 else None, *x) for i, x in enumerate(brute(all_texts))]
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups, r.n_links, r.n_best, r.count_sum) for r in got), key=str) == sorted(want, key=str)
    assert sum(x[3] > 0 for x in want) > 40 and sum(x[3] == 0 for x in want) >= 3


def test_bit_sets():
    rnd = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        x, y = (np.unique(rnd.integers(0, size + 1, size)) for _ in range(2))
        a, b = align.BitSet.of(x, size), align.BitSet.of(y, size)
        assert (a & b).select().tolist() == sorted(set(x.tolist()) & set(y.tolist()))
        assert a.rank(np.arange(size + 1)).tolist() == [int((x < i).sum()) for i in range(size + 1)]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id string, text string")
    align.align(docs, A, B).write.parquet(str(tmp_path / "a"))
    assert align.counted(spark.read.parquet(str(tmp_path / "a"))).count() == 0
