"""BPE encoding and decoding over a minimal acyclic transducer.

The tokenizer is read from a public ``tokenizer.json`` of the kind with word-end marks: NFC, lower case, words cut by a pattern, bytes
shown as letters, merges by rank. The most frequent words of the corpus are compiled into a minimal acyclic automaton (shared prefixes and
suffixes); each edge carries how many words its elder siblings lead to, so a walk sums up to the word's number, which is the place of its ids. The automaton
is a flat file; every Python worker memory-maps it. Words that it lacks are merged exactly, by rank.

Special tokens in a text are taken as such, before normalisation. Decoding joins the tokens' own strings with spaces, as the
tokenizer has no decoder. A null text is an empty one: no tokens, empty decoding. Repeated rows are encoded alike.
"""

from __future__ import annotations

import json
import mmap
import re
import sys
import tempfile
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.ship import ship
from tideline.llm.common import spare, text_of, written

#: Unicode's White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE = re.compile(f"[{WHITE}]+")
#: Merge tables hold (rank << SHIFT) | id under (left << SHIFT) | right.
SHIFT = 20
NONE = 1 << 62
#: Bits of the sieve before the automaton.
SIEVE = 1 << 19


def _members(kind: str) -> str:
    """What a character class needs for the general category that begins with ``kind``."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def _letters_first(pattern: str) -> str:
    """Runs of letters as the first alternative, which most words take; the same pattern if those before it begin with an apostrophe."""
    parts, letters = pattern.split("|"), r"[\p{L}]+"
    if letters in parts and all(p.startswith("'") for p in parts[: parts.index(letters)]):
        parts.remove(letters)
        parts.insert(0, letters)
    return "|".join(parts)


class Spec:
    """The parts of a ``tokenizer.json`` that encoding needs."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {self.vocab[a] << SHIFT | self.vocab[b]: rank << SHIFT | self.vocab[a + b] for rank, (a, b) in reversed(list(enumerate(pairs)))}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = _letters_first(split["pattern"]["Regex"])
        for name, members in ((r"\p{L}", _members("L")), (r"\p{N}", _members("N")), (r"\s", WHITE)):
            pattern = pattern.replace(f"[{name}]", f"[{members}]").replace(name, members)
        self.words = re.compile(pattern)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        letters = byte_letters()
        self.first = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]

    def chunks(self, text: str) -> list[str]:
        """The normalised text between white space, which no word crosses."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for split() only
            return [c for c in SPACE.split(text) if c]
        return text.split()

    def merge(self, word: str) -> list[int]:
        """The ids of one word, by merging the pair of lowest rank until none is left."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.first[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        get = self.merges.get
        ranks = [get(a << SHIFT | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            ids[i] = best & (1 << SHIFT) - 1
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << SHIFT | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << SHIFT | ids[i], NONE)
        return ids

    def pieces(self, text: str | None) -> list[str | int]:
        """Chunks and, as numbers, special tokens."""
        if not text:
            return []
        if not any(s in text for s in self.specials):
            return self.chunks(text)
        out: list[str | int] = []
        for part in re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", text):
            out += [self.specials[part]] if part in self.specials else self.chunks(part)
        return out


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """A file with the minimal automaton of the words and their ids. Sections: counts, edge ranges, targets, skips, id offsets, ids, labels, finals, and a sieve of the words' checksums."""
    entries = sorted(dict(entries).items())
    registry: dict[tuple, int] = {}
    nodes: list[tuple[bool, list[tuple[int, int]]]] = []
    reach: list[int] = []

    def freeze(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in registry:
            registry[key] = len(nodes)
            nodes.append((final, edges))
            reach.append(final + sum(reach[t] for _, t in edges))
        return registry[key]

    path: list[list] = [[False, []]]  # unfrozen states along the last word
    before = b""
    for word, _ in [*entries, (b"", [])]:
        common = 0
        while common < min(len(word), len(before)) and word[common] == before[common]:
            common += 1
        for depth in range(len(before), common, -1):
            final, edges = path.pop()
            path[-1][1].append((before[depth - 1], freeze(final, edges)))
        path += [[False, []] for _ in word[common:]]
        if word:
            path[-1][0] = True
        before = word
    root = freeze(*path[0])

    ranges = np.zeros(len(nodes) + 1, np.int32)
    ranges[1:] = np.cumsum([len(e) for _, e in nodes])
    labels = np.array([b for _, e in nodes for b, _ in e], np.uint8)
    targets = np.array([t for _, e in nodes for _, t in e], np.int32)
    skips = []
    for final, edges in nodes:
        passed = int(final)
        for _, t in edges:
            skips.append(passed)
            passed += reach[t]
    finals = np.array([f for f, _ in nodes], np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(i) for _, i in entries])]).astype(np.int32)
    ids = np.array([i for _, x in entries for i in x], np.int32)
    sieve = np.zeros(SIEVE, bool)
    sieve[[crc32(w) % SIEVE for w, _ in entries]] = True
    arrays = [ranges, targets, np.array(skips, np.int32), offsets, ids, labels, finals, np.packbits(sieve, bitorder="little")]
    return np.array([root, *[a.size for a in arrays]], np.int32).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The compiled file, mapped into memory."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # has no name, so nothing is left behind
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        head = view[:36].cast("i")
        self.root, at, parts = head[0], 36, []
        for size, kind in zip(head[1:9], "iiiiiBBB", strict=True):
            width = 4 if kind == "i" else 1
            parts.append((at, view[at : at + size * width].cast(kind)))
            at += size * width
        self.base = parts[5][0]  # of the labels, which are searched in place
        self.ranges, self.targets, self.skips, self.offsets, self.ids, _, self.finals, self.sieve = [p for _, p in parts]

    def find(self, word: bytes) -> list[int] | None:
        mark = crc32(word) % SIEVE
        if not self.sieve[mark >> 3] >> (mark & 7) & 1:  # most rare words are not walked
            return None
        node, number = self.root, 0
        seek, base, ranges = self.map.find, self.base, self.ranges
        for i in range(len(word)):
            at = seek(word[i : i + 1], base + ranges[node], base + ranges[node + 1]) - base
            if at < 0:
                return None
            number += self.skips[at]
            node = self.targets[at]
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist() if self.finals[node] else None


class Encoder:
    """Encodes texts; keeps what it knows of the chunks seen last, as (number of ids, ids as text, strings as text)."""

    def __init__(self, spec: Spec, lexicon: Lexicon | None = None, most: int = 400_000):
        self.spec, self.lexicon, self.most = spec, lexicon, most
        self.known: dict[str | int, tuple[int, str, str]] = {}

    def ids_of(self, piece: str | int) -> list[int]:
        if isinstance(piece, int):
            return [piece]
        ids: list[int] = []
        for word in self.spec.words.findall(piece):
            found = self.lexicon.find(word.encode("utf-8", "surrogatepass")) if self.lexicon else None
            ids += self.spec.merge(word) if found is None else found
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.spec.pieces(text) for i in self.ids_of(p)]

    def decode(self, ids: Iterable[int]) -> str:
        strings = self.spec.strings
        return " ".join([strings[i] for i in ids if i in strings])

    def written(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, their ids and their strings joined by spaces: what encoding and then decoding give."""
        if len(self.known) > self.most:
            self.known = {}
        pieces, known = self.spec.pieces(text), self.known
        found = list(map(known.get, pieces))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    if (x := known.get(pieces[i])) is None:
                        ids = self.ids_of(pieces[i])
                        x = known[pieces[i]] = len(ids), " ".join(map(str, ids)), self.decode(ids)
                    found[i] = x
        return sum([p[0] for p in found]), " ".join([p[1] for p in found]), " ".join([p[2] for p in found])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(source: str, file: bytes) -> Encoder:
    """One for each tokenizer and lexicon in a worker process, which serves many tasks."""
    key = sha256(source.encode() + file).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Spec(source), Lexicon(file))
    return _ENCODERS[key]


def frequent_words(docs: DataFrame, spec: Spec, most: int, text: str = "text") -> list[str]:
    """The ``most`` most frequent runs of letters, counted over all documents, by count and then by word.

    The least count that is needed comes from a histogram of the counts, so only words at or above it are sorted out.
    """
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(text_of(docs, text)), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    found = written(found.groupBy("w").count(), "words")
    least, sofar = 1, 0
    for r in found.groupBy("count").agg(F.count("w").alias("n")).orderBy(F.desc("count")).limit(most).toLocalIterator():
        least, sofar = r["count"], sofar + r.n
        if sofar >= most:
            break
    top = found.filter(F.col("count") >= least).orderBy(F.desc("count"), "w").limit(most)
    return sorted({w for r in top.toLocalIterator() for c in spec.chunks(r.w) for w in spec.words.findall(c)})


def encode(docs: DataFrame, tokenizer_json: str, lexicon_words: int = 20_000, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``decoded``, which take the place of columns of these names."""
    return _run(docs, tokenizer_json, lexicon_words, text, digest=False)


def digests(docs: DataFrame, tokenizer_json: str, lexicon_words: int = 20_000, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, which take the place of columns of these names: the same encoding, of which only SHA-256 leaves the worker."""
    return _run(docs, tokenizer_json, lexicon_words, text, digest=True)


def _run(docs: DataFrame, tokenizer_json: str, lexicon_words: int, text: str, digest: bool) -> DataFrame:
    ship(docs.sparkSession)
    with open(tokenizer_json, encoding="utf-8") as f:
        source = f.read()
    spec = Spec(source)
    words = frequent_words(docs, spec, lexicon_words, text)
    file = compile_lexicon((w.encode("utf-8", "surrogatepass"), spec.merge(w)) for w in words)
    shared = docs.sparkSession.sparkContext.broadcast((source, file))
    kinds = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digest else [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]

    @F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in kinds]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(*shared.value)
        for texts in batches:
            rows = []
            for t in texts:
                if digest:
                    n, ids, strings = encoder.written(t)
                    rows.append((n, sha256(ids.encode()).hexdigest(), sha256(strings.encode()).hexdigest()))
                else:
                    ids = encoder.encode(t)
                    rows.append((ids, encoder.decode(ids)))
            yield pd.DataFrame(rows, columns=[n for n, _ in kinds], index=texts.index)

    (made,) = spare(docs, "made")
    out = docs.withColumn(made, run(docs[text].cast("string")))
    return out.withColumns({n: F.col(made)[n] for n, _ in kinds}).drop(made)
