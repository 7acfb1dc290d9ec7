"""Language-model scores from a probabilistic suffix tree over words.

A text's tokens are its words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and one end. The root of the tree predicts a token by its count in the training texts with additive smoothing. Contexts are
the up to ``depth`` words before a token; all that training has ``min_count`` times are tested. A context is a state if its next tokens diverge from
what its suffix predicts: predicted by the other occurrences of the context (leave one out), mixed with the suffix's distribution as ``m`` further tokens would be, the training tokens that
follow it must gain ``cutoff`` nats or more. ``m`` is chosen for each state among ``STRENGTHS`` by that gain. Contexts that are no states predict as their suffix does, so
a token is scored by the longest suffix of the words before it that is a state.

The tree has no bound, nor does it ever lie in one place: it grows with the corpus and is dealt out by context. Texts are tokenised once into chunks of some million tokens. A
chunk sends its different words, then its different pairs of context and next token, with their training counts, to the buckets that own them; a bucket adds up what all chunks sent, tests its contexts (those that
it shares with other buckets are summed over them) and sends the sums back. So a frequent word or context moves once for each chunk, a context of many occurrences is split by next token into buckets, and words and pairs are compared whole (by word, then by number),
not by hash. Each further level reads the chunks again with the answers so far.

Null and empty texts have the end only. Repeated rows are scored alike and count as often as they stand there. Without training texts every token has the probability that additive smoothing gives.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.ship import ship
from tideline.llm.common import pack, unpack, written

#: Tokens of a chunk, tokens a bucket answers for, and occurrences of a context beyond which it takes several buckets.
CHUNK, BUCKET, HOT = 1 << 20, 1 << 20, 1 << 20
#: As how many tokens the suffix's distribution counts.
STRENGTHS = (1.0, 8.0, 64.0, 512.0)
ADDED = 0.1
#: What a suffix predicts goes to the test of a context in so many steps a bit.
STEPS = 32
#: The code of a context that several buckets share.
SPLIT = 255
RETURNS = "chunk long, bucket long, answers binary, contexts array<long>, seen array<long>, gains array<array<double>>"


def tokens(text: str | None) -> list[bytes]:
    """The words; the end is left out."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def _chunks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Rows of whole documents, of ``most`` tokens and the last document's. Words are numbered in the order of their CRC, the end (an empty word) among them."""
    chunk, held, size, docs, known = TaskContext.get().partitionId() << 32, [], 0, [], {b"": 0}

    def flush() -> pd.DataFrame:
        nonlocal chunk, held, size, docs, known
        words = list(known)
        order = np.lexsort((np.arange(len(words)), np.fromiter(map(zlib.crc32, words), np.int64, len(words))))
        at = np.empty(len(words), np.int32)
        at[order] = np.arange(len(words), dtype=np.int32)
        flat, length = at[np.concatenate(held)], np.array([d[1] for d in docs], np.int32)
        train = np.repeat(np.array([d[2] for d in docs], bool), length)
        state = pack(length, np.array([d[2] for d in docs], np.uint8), flat)
        row = pd.DataFrame({"chunk": [chunk], "size": [len(flat)], "n_words": [len(words)], "keys": [pd.Series([d[0] for d in docs], dtype=object).tolist()], "state": [state]})
        row["words"] = [zstandard.ZstdCompressor(level=1).compress(b" ".join([words[i] for i in order]))]
        row["n"] = [pack(np.bincount(flat[train], minlength=len(words)).astype(np.int32))]
        chunk, held, size, docs, known = chunk + 1, [], 0, [], {b"": 0}
        return row

    for batch in batches:
        for key, text, train in zip(batch["key"].astype(object).where(batch["key"].notna(), None), batch["text"], batch["train"], strict=True):
            own = tokens(text)
            held.append(np.array([*[known.setdefault(w, len(known)) for w in own], 0], np.int32))
            size += len(own) + 1
            docs.append((key, len(own) + 1, bool(train)))
            if size >= most:
                yield flush()
    if docs:
        yield flush()


def _word_requests(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, packed, n in zip(batch["chunk"], batch["words"], batch["n"], strict=True):
                words, n = zstandard.ZstdDecompressor().decompress(packed).split(b" "), unpack(n)[0]
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * buckets >> 32
                starts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(words))
                rows = [(bucket[a], chunk, zstandard.ZstdCompressor(level=1).compress(b" ".join(words[a:b])), pack(n[a:b])) for a, b in zip(starts, starts[1:], strict=False)]
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "words", "n"])

    return run


def _count_words(buckets: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The training counts and numbers of the words that each chunk asked for; one row more tells how many words and tokens there are."""
        of: dict[bytes, int] = {}
        asked = []
        for packed in rows["words"]:
            words = zstandard.ZstdDecompressor().decompress(packed).split(b" ")
            asked.append(np.fromiter((of.setdefault(w, len(of)) for w in words), np.int64, len(words)))
        total = np.zeros(len(of), np.int64)
        for at, n in zip(asked, rows["n"], strict=True):
            total[at] += unpack(n)[0]  # a chunk asks once for a word
        out = [(chunk, key[0], pack(total[at], int(key[0]) + buckets * at), None, None, None) for chunk, at in zip(rows["chunk"], asked, strict=True)]
        out.append((None, key[0], None, None, [int((total > 0).sum()), int(total.sum())], None))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in RETURNS.split(", ")])

    return run


class _Walk:
    """The tokens of a chunk, their probabilities so far, and the pairs of context and next token of the next level."""

    def __init__(self, state: bytes, words: tuple[np.ndarray, np.ndarray], n: int, v: int, min_count: int, hot: int):
        self.length, train, self.tok = unpack(state)
        self.train = np.repeat(train.astype(bool), self.length)
        self.starts = np.cumsum(self.length) - self.length
        self.seen, self.ids = words
        self.root = (self.seen + ADDED) / (n + ADDED * (v + 1))
        self.p = self.root[self.tok]
        self.min_count, self.hot = min_count, hot
        # at level 0 a pair is the token; ends lead no further
        ends = np.zeros(len(self.seen), bool)
        ends[self.tok[np.cumsum(self.length) - 1]] = True
        self.pos, self.pair = np.arange(len(self.tok)), self.tok.astype(np.int64)
        self.count, self.node = np.where(ends, 0, self.seen), self.ids

    def grow(self) -> None:
        """Pairs of the next level: of tokens whose predecessor was counted often enough as a pair to be a context."""
        led = np.append(False, (self.pos[1:] == self.pos[:-1] + 1) & (self.count[self.pair[:-1]] >= self.min_count))
        at = np.flatnonzero(led)
        code, one, pair = np.unique(self.pair[at - 1] * len(self.seen) + self.tok[self.pos[at]], return_index=True, return_inverse=True)
        before, self.word = np.divmod(code, len(self.seen))
        self.starts_of = np.flatnonzero(np.append(True, before[1:] != before[:-1])) if len(before) else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(len(self.starts_of)), np.diff(np.append(self.starts_of, len(before))))
        contexts = before[self.starts_of]
        self.context, self.context_count = self.node[contexts], self.count[contexts]
        self.pos, self.pair = self.pos[at], pair
        self.prior = self.p[self.pos[one]]

    def buckets(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each pair and the pairs in the order of buckets. Frequent contexts are split by next token."""
        split = 1 + self.context_count[self.of] // self.hot
        piece = (_mixed(self.ids[self.word] + 1) % split.astype(np.uint64)).astype(np.int64)
        bucket = (_mixed(self.context[self.of] * 8191 + piece) % np.uint64(buckets)).astype(np.int64)
        return bucket, np.argsort(bucket, kind="stable")

    def answered(self, bucket_count: int, counts: np.ndarray, nodes: np.ndarray, codes: np.ndarray, hot: dict[int, float]) -> None:
        """Takes the counts, in the order of buckets, and what each context is: a state of some strength, or none. Those of several buckets are looked up in ``hot``."""
        bucket, order = self.buckets(bucket_count)
        heads = self._heads(bucket[order], self.of[order])
        context = self.of[order][heads]
        strengths = np.zeros(len(self.context))
        strengths[context] = np.array([0.0, *STRENGTHS, 0.0])[np.minimum(codes, len(STRENGTHS) + 1)]
        for i in np.unique(context[codes == SPLIT]).tolist():
            strengths[i] = hot.get(int(self.context[i]), 0.0)
        self.count, self.node = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        self.count[order], self.node[order] = counts, nodes
        strength = strengths[self.of]
        p = np.where(strength > 0, (self.count + strength * self.prior) / (np.maximum(self.context_count[self.of], 1) + strength), self.prior)
        self.p[self.pos] = p[self.pair]

    @staticmethod
    def _heads(bucket: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Where a bucket's next context begins."""
        return np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)

    def requests(self, chunk: int, bucket_count: int) -> list[tuple]:
        bucket, order = self.buckets(bucket_count)
        n = np.bincount(self.pair[self.train[self.pos]], minlength=len(self.word)).astype(np.int32)
        sorted_bucket = bucket[order]
        cuts = np.append(np.flatnonzero(np.append(True, sorted_bucket[1:] != sorted_bucket[:-1])), len(order)) if len(order) else np.zeros(0, np.int64)
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = order[a:b]
            of = self.of[at]
            heads = self._heads(bucket[at], of)
            packed = (self.context[of[heads]], self.context_count[of[heads]], np.diff(np.append(heads, len(of))).astype(np.int32), self.ids[self.word[at]], n[at], np.round(-np.log2(self.prior[at]) * STEPS).astype(np.int16))
            out.append((sorted_bucket[a], chunk, pack(*packed)))
        return out


def _count_pairs(min_count: int, cutoff: float, buckets: int, hot: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(p) for p in rows["pairs"]]
        sizes = [len(p[3]) for p in parts]
        context, seen = (np.concatenate([np.repeat(p[i], p[2]) for p in parts]) for i in (0, 1))
        word, n, prior = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
        order = np.lexsort((word, context))
        c, w = context[order], word[order]
        new = np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1]))
        heads = np.flatnonzero(new)
        count = np.add.reduceat(n[order].astype(np.int64), heads)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        node = np.where(count >= min_count, int(key[0]) + buckets * np.arange(1, len(count) + 1), 0)
        # what a token that follows a context gains over its suffix's prediction, if predicted by the others
        c, total, prior = c[heads], seen[order][heads], 2.0 ** (-prior[order][heads] / STEPS)
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        gains = np.stack([np.add.reduceat(np.where(count > 0, count * (np.log(np.maximum(count - 1, 0) + m * prior) - np.log(total - 1 + m) - np.log(prior)), 0.0), first) for m in STRENGTHS], 1)
        best = gains.argmax(1)
        code = np.where(gains.max(1) >= cutoff, best + 1, 0).astype(np.uint8)
        split = total[first] >= hot
        code[split] = SPLIT
        known = c[first]
        out, at = [], 0
        for chunk, size, p in zip(rows["chunk"], sizes, parts, strict=True):
            own = of[at : at + size]
            codes = code[np.searchsorted(known, p[0])]
            out.append((chunk, key[0], pack(count[own], node[own], codes), p[0][codes == SPLIT].tolist(), None, None))
            at += size
        if split.any():
            out.append((None, key[0], None, known[split].tolist(), None, gains[split].tolist()))
        return pd.DataFrame(out, columns=[x.split(" ")[0] for x in RETURNS.split(", ")])

    return run


class _Levels:
    """Answers of all levels so far, and walks of the chunks with them."""

    def __init__(self, chunks: DataFrame, min_count: int, cutoff: float, bucket: int, hot: int):
        self.chunks, self.min_count, self.cutoff, self.bucket, self.hot = chunks, min_count, cutoff, bucket, hot
        size = chunks.agg(F.sum("size").alias("size"), F.sum("n_words").alias("words")).first()
        self.buckets = [(size.words or 0) // bucket + 1]
        requests = chunks.select("chunk", "words", "n").mapInPandas(_word_requests(self.buckets[0]), "bucket long, chunk long, words binary, n binary")
        found = written(requests.groupBy("bucket").applyInPandas(_count_words(self.buckets[0]), RETURNS), "words")
        self.answers = [found.filter("chunk IS NOT NULL").select("chunk", F.lit(0).alias("level"), "bucket", "answers")]
        known = found.filter("chunk IS NULL").agg(F.sum(F.col("seen")[0]).alias("v"), F.sum(F.col("seen")[1]).alias("n")).first()
        self.v, self.n, self.size = known.v or 0, known.n or 0, size.size or 0

    def walk(self, make, schema: str) -> DataFrame:
        """``make(keys, chunk, walk)`` for each chunk, grown to the next level."""
        answers = self.answers[0]
        for a in self.answers[1:]:
            answers = answers.unionByName(a, allowMissingColumns=True)
        n, v, min_count, hot, buckets = self.n, self.v, self.min_count, self.hot, self.buckets

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            def of(level: int) -> tuple[np.ndarray, ...]:
                rows = right[(right["level"] == level) & right["answers"].notna()].sort_values("bucket")
                return tuple(np.concatenate(x) for x in zip(*map(unpack, rows["answers"]), strict=True)) or (np.zeros(0, np.int64),) * 3

            walk = _Walk(left["state"].iloc[0], of(0), n, v, min_count, hot)
            for level in range(1, len(buckets)):
                walk.grow()
                states = right[(right["level"] == level) & right["answers"].isna()]
                walk.answered(buckets[level], *of(level), {s["context"]: s["strength"] for row in states["states"] for s in row})
            return make(left["keys"].iloc[0], int(left["chunk"].iloc[0]), walk)

        return self.chunks.select("chunk", "keys", "state").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, schema)

    def grow(self) -> None:
        """Counts the pairs of one level more and tests their contexts."""
        level, buckets = len(self.buckets), self.size // self.bucket + 1

        def requests(keys: list, chunk: int, walk: _Walk) -> pd.DataFrame:
            walk.grow()
            return pd.DataFrame(walk.requests(chunk, buckets), columns=["bucket", "chunk", "pairs"])

        pairs = self.walk(requests, "bucket long, chunk long, pairs binary")
        found = written(pairs.groupBy("bucket").applyInPandas(_count_pairs(self.min_count, self.cutoff, buckets, self.hot), RETURNS), "pairs")
        tested = found.filter("chunk IS NULL").select(F.explode(F.arrays_zip("contexts", "gains")).alias("x")).groupBy("x.contexts").agg(*[F.sum(F.col("x.gains")[i]).alias(f"g{i}") for i in range(len(STRENGTHS))])
        best = F.array_max(F.array(*[F.struct(F.col(f"g{i}").alias("gain"), F.lit(m).alias("strength")) for i, m in enumerate(STRENGTHS)]))
        states = tested.select(F.col("contexts").alias("context"), best.alias("b")).filter(F.col("b.gain") >= self.cutoff).select("context", F.col("b.strength").alias("strength"))
        asked = found.filter("chunk IS NOT NULL AND size(contexts) > 0").select("chunk", F.explode("contexts").alias("context")).distinct()
        told = asked.join(states, "context").groupBy("chunk").agg(F.collect_list(F.struct("context", "strength")).alias("states"))
        self.answers.append(found.filter("chunk IS NOT NULL").select("chunk", F.lit(level).alias("level"), "bucket", "answers"))
        self.answers.append(written(told.select("chunk", F.lit(level).alias("level"), "states"), "states"))
        self.buckets.append(buckets)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", depth: int = 2, min_count: int = 32, cutoff: float = 3.0, chunk: int = CHUNK, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row; logarithms are decimal.

    Texts are learned from where ``train`` is true. ``base_score`` is the root's score, ``n_known`` counts the tokens that training texts have, ``train_tokens`` all of training. Other columns are left out.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    chunks = rows.mapInPandas(lambda batches: _chunks(batches, chunk), f"chunk long, size long, n_words long, keys array<{kind}>, state binary, words binary, n binary")
    levels = _Levels(written(chunks, "chunks"), min_count, cutoff, bucket, hot)
    for _ in range(depth):
        levels.grow()

    train_tokens = levels.n

    def finish(keys: list, chunk: int, walk: _Walk) -> pd.DataFrame:
        known = np.add.reduceat((walk.seen > 0)[walk.tok].astype(np.int64), walk.starts)
        base, full = (np.add.reduceat(np.log10(p), walk.starts) for p in (walk.root[walk.tok], walk.p))
        return pd.DataFrame({"key": pd.Series(list(keys), dtype=object), "n_tokens": walk.length.astype(np.int64), "n_known": known, "train_tokens": train_tokens, "base_score": base, "score": full})

    return levels.walk(finish, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)
