"""SimHash near-duplicate groups.

Fingerprints are 64 majority bits over the XXH64 hashes of word shingles. Pairs within ``max_distance`` bits are
found by pigeonhole blocks: the bits are cut into ``max_distance + 3`` blocks, of which a close pair differs in at
most ``max_distance``, so it shares one combination of three whole blocks (38 bits or more for distance 2). Blocks
are joined and the Hamming distance is verified.

Blocks with more than ``block_limit`` different fingerprints are not joined pair by pair. Up to distance 2 their members go through an
exact detour: a fingerprint is sent to itself and to its 64 one-bit neighbours, and whatever meets at
such a centre is within two bits of each other, or within one of the centre itself. At most 65 different fingerprints can meet at a centre, so no group
grows with the data and no link is lost. Beyond distance 2 crowded blocks are dealt out in pieces, each against the whole block.

Nulls: a null text is an empty text; a null doc_id keeps its row and is never a component's name unless all of the
component's are null. Texts without words have fingerprint zero and link like any other. Repeated rows all stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.ship import ship
from tideline.llm.common import cut, spare, written

SEED = 42
BITS = 64


def hashes(text: str | None, shingle_words: int = 3) -> np.ndarray:
    """The XXH64 hashes of all shingles of one whole text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    k = min(shingle_words, len(words))
    starts = [0, *ends[: len(words) - k]]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)), np.uint64, len(starts))


def majorities(h: np.ndarray) -> np.ndarray:
    """For each bit of the rows of ``h`` (one or several words each) how often it is set less how often it is not."""
    rows = h.astype("<u8").reshape(len(h), int(np.prod(h.shape[1:])))
    ones = np.zeros(rows.shape[1] * BITS, np.int64)
    for at in range(0, len(rows), 255):  # sums of 255 bits fit a byte
        ones += np.add.reduce(np.unpackbits(rows[at : at + 255].view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return 2 * ones - len(h)


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The unsigned fingerprint of one whole text."""
    return int(np.packbits(majorities(hashes(text, shingle_words)) > 0, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle_words: int = 3) -> Column:
    """A signed long column with the fingerprint's bits."""
    ship(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle_words) for t in texts], np.uint64).view(np.int64), index=texts.index)

    return run(docs[text].cast("string"))


def _masks(max_distance: int, agree: int = 3) -> list[int]:
    n = max_distance + agree
    edges = [round(i * BITS / n) for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    return [signed(sum(c)) for c in combinations(block, agree)]


def links(fps: DataFrame, max_distance: int = 2, block_limit: int = 16, salts: int = 16) -> DataFrame:
    """Links (a, b) over the different values of ``fps.fp``, each within ``max_distance`` bits, whose closure is that of all such pairs."""
    masks = _masks(max_distance)
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("x")).select("fp", "x.t", "x.k")
    sizes = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    shared = keys.withColumn("s", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(sizes, ["t", "k", "s"])
    shared = cut(shared.select("fp", "t", "k", "s", "n"))
    few, crowded = shared.filter(F.col("n") <= block_limit), shared.filter(F.col("n") > block_limit)

    def pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        close = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_distance)
        for c in on:
            close = (F.col(f"a.{c}") == F.col(f"b.{c}")) & close
        return a.join(b, close).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    near = pairs(few, few, ["t", "k"])
    if max_distance > 2:
        to_all = crowded.drop("s").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return near.unionByName(pairs(crowded, to_all, ["t", "k", "s"])).distinct()
    flips = [0] + [1 << i for i in range(BITS - 1)] + [-(1 << (BITS - 1))]
    centres = crowded.select("fp").distinct().select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("z"))
    met = centres.groupBy("z").agg(F.sort_array(F.collect_list("fp")).alias("m")).filter(F.size("m") > 1)
    if max_distance == 2:
        star = met.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, BITS + 1)).alias("b"))
    else:  # one bit apart are a centre that is there itself and what meets at it
        star = met.filter(F.array_contains("m", F.col("z"))).select(F.col("z").alias("a"), F.explode("m").alias("b")).filter("a < b")
    return near.unionByName(star.filter(F.lit(max_distance > 0))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest value reachable over ``edges``. Labels spread and jump; each round is written, so that no estimate of size is carried from round to round.

    A value with many edges is no hot key: the joins on it may be split by the adaptive plan, the sums on it are made before rows move.
    """
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = written(both.groupBy(F.col("u").alias("fp")).agg(F.least(F.min("v"), F.col("fp")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("fp").alias("v"), F.col("root").alias("r")), "v").groupBy(F.col("u").alias("fp")).agg(F.min("r").alias("r"))
        step = labels.join(near, "fp").select("fp", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = step.join(labels.select(F.col("fp").alias("root"), F.col("root").alias("far")), "root", "left")
        new = written(jump.select("fp", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        labels = new.select("fp", "root")
        if new.filter("root < old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_distance: int = 2, shingle_words: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), fingerprint (16 hex digits), component_id (smallest doc_id)."""
    marked = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(docs, text, shingle_words).alias("fp")))
    first = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(first.select("fp"), max_distance))
    of = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = of.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Wide fingerprints: 64-bit lanes; rotations of the majorities; coordinates that a symbol is chosen from; symbols in a block key, blocks.
LANES, ROTATIONS, GROUP, SYMBOLS, BLOCKS = 8, 96, 512, 3, 64
WIDE = LANES * BITS
_DEAL = np.random.default_rng(0)
_SIGNS = _DEAL.choice(np.array([-1, 1], np.float32), (ROTATIONS, WIDE))
#: Each symbol goes into two keys.
_SUBSETS = np.concatenate([_DEAL.permutation(ROTATIONS * WIDE // GROUP).reshape(-1, SYMBOLS) for _ in range(2)])


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


_LEFT, _RIGHT = _hadamard(32), _hadamard(WIDE // 32)


def wide_majorities(text: str | None, shingle_words: int = 5) -> tuple[np.ndarray, int, int]:
    """(majorities, size, id) of the set of shingles: ``WIDE`` majorities over remixed hashes, how many shingles differ, and a hash of the whole set."""
    h = np.unique(hashes(text, shingle_words))
    lane = np.arange(LANES, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = h[:, None] * (np.uint64(2) * lane + np.uint64(1)) + lane
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return majorities(x ^ (x >> np.uint64(29))), len(h), int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))


def block_keys(m: np.ndarray, chunk: int = 128) -> np.ndarray:
    """The block keys (rows x ``BLOCKS``) of rows of majorities.

    A fingerprint's bits with a small majority flip first when a text is edited, so blocks are not cut from the bits as they are. The majorities are rotated (random
    signs, then a Hadamard transform); of each rotation the largest coordinate gives its place and sign as a symbol of ten bits, and a block is three symbols.
    """
    m = m >> np.maximum(np.frexp(np.abs(m).max(axis=1, initial=1).astype(np.float64))[1] - 14, 0)[:, None]  # sums stay exact in single precision
    out = np.empty((len(m), BLOCKS), np.uint64)
    for at in range(0, len(m), chunk):
        part = m[at : at + chunk].astype(np.float32)
        n = len(part)
        symbols = np.empty((n, ROTATIONS * WIDE // GROUP), np.uint64)
        for r in range(ROTATIONS):
            x = (part * _SIGNS[r]).reshape(-1, 32) @ _LEFT
            x = x.reshape(n, -1, 32).transpose(0, 2, 1).reshape(-1, WIDE // 32) @ _RIGHT
            x = x.reshape(n * WIDE // GROUP, GROUP)
            best = np.abs(x).argmax(1)
            s = best * 2 + (x[np.arange(len(best)), best] > 0)
            symbols[:, r * WIDE // GROUP : (r + 1) * WIDE // GROUP] = s.reshape(n, -1)
        keys = np.broadcast_to(np.arange(1, BLOCKS + 1, dtype=np.uint64), (n, BLOCKS)).copy()
        with np.errstate(over="ignore"):
            for column in _SUBSETS.T:
                keys = (keys ^ symbols[:, column]) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(29)
        out[at : at + n] = keys
    return out.view(np.int64)


def wide_fingerprints(texts: pd.Series, shingle_words: int, least: int, blocks: Callable[[np.ndarray], np.ndarray]) -> pd.DataFrame:
    """fp (id of the shingle set), n (its size), bits, keys of each text; sets of fewer than ``least`` shingles get no keys."""
    made = [wide_majorities(t, shingle_words) for t in texts]
    m = np.array([x[0] for x in made]).reshape(-1, WIDE)
    n = np.array([x[1] for x in made], np.int64)
    keys, none = blocks(m), np.zeros(0, np.int64)
    bits = np.packbits(m > 0, axis=1, bitorder="little").view("<i8")
    return pd.DataFrame({"fp": [x[2] for x in made], "n": n, "bits": list(bits), "keys": [k if s >= least else none for k, s in zip(keys, n, strict=True)]}, index=texts.index)


#: Blocks whose leaders are tried first; fingerprints beyond which a block is dealt out; pieces of such blocks.
FIRST, CROWD, SALTS = 8, 64, 16


def _apart(x: str, y: str) -> Column:
    """Differing bits of two fingerprints."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(1, LANES)), F.bit_count(F.get(x, F.lit(0)).bitwiseXOR(F.get(y, F.lit(0)))))


def _pieces(n: Column) -> Column:
    """All pieces of a block of ``n`` fingerprints, as an array."""
    return F.sequence(F.lit(0), F.when(n > CROWD, SALTS - 1).otherwise(0))


def _piece(n: Column) -> Column:
    """A fingerprint's own piece of its block."""
    return F.when(n > CROWD, F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(SALTS)).cast("int")).otherwise(0)


def _mixed(nodes: DataFrame, roots: DataFrame, blocks: int) -> DataFrame:
    """(k, fp, root, n, n_block): the members of the first ``blocks`` blocks of each fingerprint that hold several groups. Only sizes and least and greatest groups are joined to members."""
    of = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "n", F.explode(F.slice("keys", 1, blocks)).alias("k"))
    sizes = of.groupBy("k").agg(F.count(F.lit(1)).alias("n_block"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    return written(of.join(sizes.select("k", "n_block"), "k").select("k", "fp", "root", "n", "n_block"), "mixed")


def _to_leaders(mixed: DataFrame) -> DataFrame:
    """Pairs (fp, to) of members and their block's leader, if that is of another group.

    The leader is the member that meets most others over all its blocks: of a family of copies the one that the others were made from, or the next to it. Equals are told apart by a hash.
    """
    mix = F.xxhash64("k")
    met = mixed.groupBy("fp").agg(F.sum("n_block").alias("met"))
    best = F.min(F.struct((-F.col("met")).alias("less"), F.col("fp").bitwiseXOR(mix).alias("m"), F.col("fp").alias("to"), F.col("root").alias("its")))
    heads = mixed.join(met, "fp").groupBy("k", "n_block").agg(best.alias("h")).select("k", "h.to", "h.its", F.explode(_pieces(F.col("n_block"))).alias("s"))
    return mixed.withColumn("s", _piece(F.col("n_block"))).join(heads, ["k", "s"]).filter("root <> its").select("fp", "to").distinct()


def _across(mixed: DataFrame, bits: DataFrame, similarity: float, limit: int) -> DataFrame:
    """All pairs (a, b) of a block that are of different groups, near in size and in fingerprint; nothing else leaves the join. One side of a crowded block goes to all pieces, so that no pair is left out and none meets in one task."""
    full = mixed.join(bits, "fp")
    left = full.select("k", "fp", "root", "n", "bits", _piece(F.col("n_block")).alias("s"))
    right = full.select(F.col("k").alias("block"), F.col("fp").alias("to"), F.col("root").alias("its"), F.col("n").alias("m"), F.col("bits").alias("others"), F.explode(_pieces(F.col("n_block"))).alias("piece"))
    near = (F.col("k") == F.col("block")) & (F.col("s") == F.col("piece")) & (F.col("root") < F.col("its")) & (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9) & (_apart("bits", "others") <= limit)
    return left.join(right, near).select(F.least("fp", "to").alias("a"), F.greatest("fp", "to").alias("b")).distinct()


def _nearest(pairs: DataFrame, nodes: DataFrame, similarity: float, limit: int) -> DataFrame:
    """Of the pairs (fp, to) that are near in size and fingerprint, the nearest of each ``fp``, as (a, b)."""
    mine = nodes.select("fp", "n", "bits")
    its = nodes.select(F.col("fp").alias("to"), F.col("n").alias("m"), F.col("bits").alias("others"))
    near = pairs.join(mine, "fp").join(its, "to").filter(F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9).select("fp", "to", _apart("bits", "others").alias("apart"))
    best = near.filter(F.col("apart") <= limit).groupBy("fp").agg(F.min(F.struct("apart", "to")).alias("m"))
    return best.select(F.least("fp", "m.to").alias("a"), F.greatest("fp", "m.to").alias("b")).distinct()


#: Up to so many texts to be compared, their ids are broadcast; beyond, texts are joined by shuffle.
FEW = 100_000


class _Texts:
    """Shingle sets of fingerprints' texts, each read once."""

    def __init__(self, docs: DataFrame, doc_id: str, body: Column, marked: DataFrame, shingle_words: int):
        self.bodies = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("own"), body.alias("body"))
        self.at = marked.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("fp", "r.*")
        self.sets: DataFrame | None = None
        self.shingle_words = shingle_words

    def alike(self, pairs: DataFrame, similarity: float) -> DataFrame:
        """The pairs (a, b) whose sets of shingles are alike to ``similarity`` or more."""
        words = self.shingle_words

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([np.unique(hashes(t, words)).view(np.int64) for t in texts], index=texts.index, dtype=object)

        pairs = written(pairs, "pairs")
        ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        if self.sets is not None:
            ends = ends.join(self.sets.select("fp"), "fp", "left_anti")
        need = written(self.at.join(ends, "fp"), "need")
        few = F.broadcast(need) if need.count() <= FEW else need
        texts = self.bodies.join(few, self.bodies["id"].eqNullSafe(few["doc_id"]) & (self.bodies["own"] == few["th"])).select("fp", "body").dropDuplicates(["fp"])
        new = cut(texts.select("fp", shingles("body").alias("set")))
        self.sets = new if self.sets is None else self.sets.unionByName(new)
        both = pairs.join(self.sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(self.sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return written(both.filter(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"), "links")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, th (hash of the text), component_id and root (the group), for texts whose shingles are alike to ``similarity`` or more.

    Texts with equal sets of shingles are one fingerprint from the start. Two fingerprints are linked if they share a block, differ in at most ``limit`` bits (the
    expectation at ``similarity`` and three standard deviations more) and their shingle sets, compared whole, are alike to ``similarity``; groups are what links reach.
    Links that cannot change the groups are spared: first members are compared with leaders of their first blocks, then with leaders of all blocks that still hold
    several groups, and in what is left all pairs across groups. So groups depend on the texts only, neither on the choice of leaders nor on partitions.

    At this similarity a pair differs in 15 % of the bits, and no pigeonhole of blocks that select anything can promise a block to every such pair: blocks are a matter of
    chance. Recall is measured in the README; equal sets always meet. Sets too small to be alike without being equal have no blocks.
    """
    ship(docs.sparkSession)
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine) / np.pi)
    limit = int(WIDE * share + 3 * np.sqrt(WIDE * share * (1 - share)))
    least = int(np.floor(similarity / (1 - similarity) + 1e-9)) if similarity < 1 else 1 << 30

    @F.pandas_udf("fp long, n int, bits array<long>, keys array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield wide_fingerprints(texts, shingle_words, least, block_keys)

    body = docs[text].cast("string")
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("th"), run(body).alias("w")).withColumn("row", F.monotonically_increasing_id())
    marked = cut(marked.select("doc_id", "th", "row", "w.fp", "w.n", "w.bits", "w.keys"))
    one = marked.groupBy("fp").agg(F.min("row").alias("row"))
    nodes = marked.join(one.select("row"), "row", "left_semi").filter(F.size("keys") > 0).select("fp", "n", "bits", "keys")
    texts = _Texts(docs, doc_id, body, marked, shingle_words)
    nobody = nodes.sparkSession.createDataFrame([], "fp long, root long")

    links = texts.alike(_nearest(_to_leaders(_mixed(nodes, nobody, FIRST)), nodes, similarity, limit), similarity)
    mixed = _mixed(nodes, components(links), BLOCKS)
    links = links.unionByName(texts.alike(_nearest(_to_leaders(mixed), nodes, similarity, limit), similarity))
    roots = components(links)
    mixed = mixed.drop("root").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    left = mixed.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("k")
    across = _across(written(mixed.join(left, "k", "left_semi"), "mixed"), nodes.select("fp", "bits"), similarity, limit)
    roots = components(links.unionByName(texts.alike(across, similarity)))
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.select("doc_id", "th", "fp").join(first.select("fp", "root").join(named, "root"), "fp").select("doc_id", "th", "component_id", "root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of alike texts: that of the smallest doc_id, of its texts that of the smallest hash, and one of its rows if they repeat.

    Rows with null ids go if their group has another; of a group with null ids only, one row stays.
    """
    groups = cut(similar_groups(docs, doc_id, text, shingle_words, similarity))
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th")).alias("best"))
    marked = cut(groups.groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("n")).join(best, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))))
    own, id_, th = spare(docs, "own", "id", "th")
    ids = [F.col("doc_id").alias(id_), F.col("th").alias(th)]
    same = lambda d: d[doc_id].eqNullSafe(F.col(id_)) & (d[own] == F.col(th))
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))))
    gone = marked.filter(~F.col("stays")).select(*ids)
    kept = hashed.join(gone, same(hashed), "left_anti")
    repeated = marked.filter(F.col("stays") & (F.col("n") > 1)).select(*ids)
    if repeated.isEmpty():
        return kept.drop(own)
    once = kept.join(repeated, same(kept), "left_anti")
    twice = kept.join(repeated, same(kept), "left_semi").dropDuplicates([own])  # a text has one root and a root one text that stays
    return once.unionByName(twice).drop(own)
