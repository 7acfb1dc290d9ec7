"""Alignment of two tokenizers' tokens of the same texts.

Both tokenizers cut the bytes of a space and the text. A bit set marks the bytes at which tokens of one end, another those of the other; their AND has the shared cuts. Its set bits are
selected as byte offsets, and the number of set bits before an offset (population counts summed up by word) tells which token of each side ends there. The shared cuts part a
text into groups of tokens of both sides that cover the same bytes; the two tokens that end a group end together, which is a link.

How often a pair of ids is linked is counted over all texts: links are first counted within chunks of some hundred thousand, the pairs' counts summed over chunks, and sent back to the chunks that hold
them, so a frequent pair moves once a chunk and nothing is broadcast.

The first tokenizer is byte-level BPE from a ``tokenizer.json``, the second a sentencepiece model with byte fallback. Strings of special tokens in a text are plain text. Texts that are null or empty, or that
either tokenizer changes (so that its tokens do not join to the same bytes), have no tokens: all numbers 0, groups empty. Repeated rows are aligned alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.ship import ship
from tideline.llm.bpe import byte_letters
from tideline.llm.common import pack, unpack, written

# Fixed value: how byte-level BPE cuts a text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text that are aligned at once, and links of a chunk.
AT_ONCE, CHUNK_LINKS = 1 << 19, 400_000
PAIR = 32


class ByteLevel:
    """A byte-level BPE vocabulary whose ids are in the order of its merges."""

    def __init__(self, tokenizer_json: str):
        model = json.loads(tokenizer_json)["model"]
        letters = {x: b for b, x in enumerate(byte_letters())}
        ranks = {bytes(letters[x] for x in token): i for token, i in model["vocab"].items() if all(x in letters for x in token)}
        made = [ranks[bytes(letters[x] for x in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("ids must follow the order of merges")
        self.encoding = tiktoken.Encoding("byte level", pat_str=WORDS, mergeable_ranks={t: i for t, i in ranks.items() if len(t) == 1 or i >= made[0]}, special_tokens={})
        self.strings = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.strings[i] = t

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]


class Pieces:
    """A sentencepiece model, which puts the space before a text itself."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        m = self.model
        self.strings = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(m.id_to_piece, range(m.get_piece_size())))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


class BitSet:
    """Marked offsets, 64 to a word, with the population counts before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, at: np.ndarray, size: int) -> BitSet:
        flags = np.zeros((size // 64 + 1) * 64, bool)
        flags[at] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: BitSet) -> BitSet:
        return BitSet(self.words & other.words)

    def select(self) -> np.ndarray:
        """All marked offsets, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many offsets below each of ``at`` are marked."""
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)


class Aligner:
    def __init__(self, a: ByteLevel, b: Pieces):
        self.sides = a, b
        self.lengths = [np.array([len(s) for s in x.strings], np.int64) for x in self.sides]
        # what is written for an id: followed by a comma, or by what ends its side of a group
        self.written = np.array([f"{i}{end}" for x, last in zip(self.sides, "|;", strict=True) for i in range(len(x.strings)) for end in (",", last)], dtype=object)

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, bytes]]:
        """(tokens of each side, groups, groups as text, links as packed pairs of ids) of each text."""
        out = [(0, 0, 0, "", b"")] * len(texts)
        at = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in at]
        ids = [x.encode(spaced) for x in self.sides]
        whole = [all(b"".join([x.strings[i] for i in own]) == raw for x, own in zip(self.sides, both, strict=True)) for raw, *both in zip([t.encode() for t in spaced], *ids, strict=True)]
        at = [i for i, ok in zip(at, whole, strict=True) if ok]
        if not at:
            return out
        ids = [[own for own, ok in zip(x, whole, strict=True) if ok] for x in ids]
        n = np.array([[len(own) for own in x] for x in ids])
        flat = [np.fromiter((i for own in x for i in own), np.int64, count) for x, count in zip(ids, n.sum(1), strict=True)]
        ends = [np.cumsum(length[x]) for length, x in zip(self.lengths, flat, strict=True)]
        size = int(ends[0][-1])
        sets = [BitSet.of(e, size) for e in ends]
        shared = sets[0] & sets[1]
        cuts = shared.select()
        last = [s.rank(cuts) for s in sets]
        links = flat[0][last[0]] << PAIR | flat[1][last[1]]

        # each token's place where the groups' sides are written one after the other
        group = [shared.rank(e) for e in ends]
        place = [np.arange(len(flat[0])) + np.append(0, last[1] + 1)[group[0]], np.arange(len(flat[1])) + last[0][group[1]] + 1]
        codes = np.empty(len(flat[0]) + len(flat[1]), np.int64)
        for side, start in ((0, 0), (1, 2 * len(self.lengths[0]))):
            codes[place[side]] = start + 2 * flat[side] + (ends[side] == cuts[group[side]])
        strings = self.written[codes].tolist()
        stops = np.cumsum(n.sum(0))
        groups = np.searchsorted(cuts, ends[0][np.cumsum(n[0]) - 1], side="right")
        begin = first = 0
        for k, i in enumerate(at):
            out[i] = int(n[0][k]), int(n[1][k]), int(groups[k] - first), "".join(strings[begin : stops[k]])[:-1], pack(links[first : groups[k]])
            begin, first = stops[k], groups[k]
        return out


def align(docs: DataFrame, a_json: str, b_model: str, key: str = "doc_id", text: str = "text", at_once: int = AT_ONCE, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """(key, n_a, n_b, n_groups, groups, links, chunk) of every row; ``groups`` is like ``a1,a2|b1;a3|b2,b3`` and ``links`` has packed pairs of ids, for ``counted``."""
    ship(docs.sparkSession)
    with open(a_json, encoding="utf-8") as f, open(b_model, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    columns = ["key", "n_a", "n_b", "n_groups", "groups", "links", "chunk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, chunk, held = Aligner(ByteLevel(shared.value[0]), Pieces(shared.value[1])), TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            size = batch["text"].str.len().fillna(0).cumsum()
            for _, part in batch.groupby((size // at_once).astype("int64").to_numpy(), sort=False):
                rows = [(k, *x, chunk) for k, x in zip(part["key"], aligner.align(part["text"].tolist()), strict=True)]
                held += sum(r[3] for r in rows)
                if held >= chunk_links:
                    chunk, held = chunk + 1, 0
                out = pd.DataFrame(rows, columns=columns, index=part.index)
                yield out.assign(key=part["key"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInPandas(run, f"key {kind}, n_a long, n_b long, n_groups long, groups string, links binary, chunk long").withColumnRenamed("key", key)


def _flat(links: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[unpack(x)[0] for x in links if x]])


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for chunk, links in batch.groupby("chunk", sort=False)["links"]:
            pairs, n = np.unique(_flat(links), return_counts=True)
            yield pd.DataFrame({"chunk": chunk, "pair": pairs, "n": n.astype(np.int64)})


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(chunk, pair, n): how often a chunk links a pair."""
    return aligned.select("chunk", "links").mapInPandas(_pairs, "chunk long, pair long, n long")


def counted(aligned: DataFrame, drop: tuple[str, ...] = ("links", "chunk")) -> DataFrame:
    """``aligned`` (its rows must be stored, as they are read twice) with ``n_links``, ``n_best`` (links of a count that is their second id's highest) and ``count_sum`` in place of the columns in ``drop``."""
    by_chunk = written(pair_counts(aligned), "pairs")
    counts = by_chunk.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << PAIR) - 1)))
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    rated = counts.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    back = by_chunk.select("chunk", "pair").distinct().join(rated, "pair")
    kept = [f for f in aligned.schema if f.name not in drop]

    def sums(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values("pair")
        at = np.searchsorted(pairs["pair"].to_numpy(), _flat(rows["links"]))
        n = rows["n_groups"].to_numpy()  # a group ends in one link
        ends = np.cumsum(n)

        def of(x: np.ndarray) -> np.ndarray:
            upto = np.append(0, np.cumsum(x, dtype=np.int64))
            return upto[ends] - upto[ends - n]

        counts, is_best = pairs["n"].to_numpy()[at], pairs["best"].to_numpy().astype(np.int64)[at]
        return rows[[f.name for f in kept]].assign(n_links=n, n_best=of(is_best), count_sum=of(counts))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return aligned.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(sums, f"{schema}, n_links long, n_best long, count_sum long")
