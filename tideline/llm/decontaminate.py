"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (an item of fewer words, but not none, is one window). The
words of each window are ordered by their frequency in the documents, rarest first. A text holds a window only if it holds all of
its words, so the necessary prefix is one word, the rarest, with its offset in the window. Documents look up their
words in a bit set of these prefix words, which needs no shuffle; each word that may be one goes on alone
with its neighbourhood of ``2 * window - 1`` words. It is joined on the prefix word, must leave room for the window on both
sides (positional and length bounds), and the window is then compared word by word.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null texts have no words. Repeated document rows
each get their own result row; repeated or null item_ids are taken as they come (a null id counts as a hit but not as an item).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, cut, spare, text_of

#: Everything that ends a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The places of prefix words that have more than so many are dealt out in pieces, of about so many for the commonest; a window of such a word goes to all of them.
PLACES = 10_000


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), GAP), lambda w: w != "")


def _windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item_id, w): the different windows of each item."""
    w = items.select(F.col(item_id).cast("string").alias("item_id"), words(text_of(items, text)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("ws"), i, window))).alias("w")).distinct()


class _BitSet:
    """A literal bit set over the column ``h`` of ``df``; it lets some others pass, which the join removes.

    The bits are set by an aggregate, so the driver gets at most ``max_bits / 64`` longs however many words the benchmark has.
    """

    def __init__(self, df: DataFrame, max_bits: int = 1 << 21):
        most, n = 64 * df.select("h").distinct().count(), 1 << 12
        while n < most and n < max_bits:
            n <<= 1
        at = F.col("h").bitwiseAND(F.lit(n - 1))
        words = df.groupBy(F.shiftright(at, 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        self.n, self.longs = n, [0] * (n // 64)
        for r in words.collect():
            self.longs[r.i] = r.bits

    def has(self, h: Column) -> Column:
        at = h.bitwiseAND(F.lit(self.n - 1))
        word = F.get(F.lit(self.longs).cast("array<bigint>"), F.shiftright(at, 6).cast("int"))
        return F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1


def hits(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """(__id, __th, item_id, start, len): each occurrence of a window, positions from 0."""
    wins = cut(_windows(items, item_id, item_text, window))
    vocabulary = cut(wins.select(F.explode("w").alias("t")).distinct().withColumn("h", F.xxhash64("t")))
    known = _BitSet(vocabulary)
    body = docs.select(F.col(doc_id).alias("__id"), F.xxhash64(text_of(docs, text)).alias("__th"), words(text_of(docs, text)).alias("ws"))

    seen = body.select(F.explode(F.filter(F.transform("ws", lambda x: F.xxhash64(x)), known.has)).alias("h"))
    counts = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(vocabulary.join(counts, "h", "left").select("t", "h", F.coalesce("n", F.lit(0)).alias("n")))

    placed = wins.select("item_id", "w", F.posexplode("w").alias("o", "t")).join(counts, "t")
    rarest = placed.groupBy("item_id", "w").agg(F.min(F.struct("n", "h", "o", "t")).alias("r"))
    prefix = cut(rarest.select("item_id", "w", F.size("w").alias("len"), F.col("r.t").alias("t"), F.col("r.h").alias("h"), F.col("r.o").alias("o"), F.col("r.n").alias("n")))
    necessary = _BitSet(prefix)

    reach = 2 * window - 1
    spots = F.filter(F.transform("ws", lambda x, i: F.when(necessary.has(F.xxhash64(x)), i)), lambda i: i.isNotNull())
    near = body.select("__id", "__th", F.explode(F.transform(spots, lambda i: F.struct(i.alias("p"), F.get(F.col("ws"), i).alias("t"), F.greatest(i - window + 1, F.lit(0)).alias("from"), F.slice(F.col("ws"), F.greatest(i - window + 2, F.lit(1)), reach).alias("around")))).alias("x")).select("__id", "__th", "x.*")
    # places of frequent words are dealt out, and only their windows copied; which words these are is told without a join
    pieces = F.lit((prefix.agg(F.max("n")).first()[0] or 0) // PLACES + 1)
    frequent = _BitSet(prefix.filter(F.col("n") > PLACES))
    own = F.when(frequent.has(F.xxhash64("t")), F.pmod(F.xxhash64("__id", "__th", "p"), pieces).cast("int")).otherwise(0)
    dealt = prefix.select("*", F.explode(F.when(frequent.has(F.col("h")), F.sequence(F.lit(0), (pieces - 1).cast("int"))).otherwise(F.array(F.lit(0)))).alias("s")).drop("n")
    found = near.withColumn("s", own).join(dealt, ["t", "s"])
    first = F.col("p") - F.col("o")
    room = (first >= F.col("from")) & (first - F.col("from") + F.col("len") <= F.size("around"))
    same = F.slice(F.col("around"), F.when(room, first - F.col("from") + 1).otherwise(1), F.col("len")) == F.col("w")
    return found.filter(room & same).select("__id", "__th", "item_id", first.alias("start"), "len")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, __th (hash of the text), n_words, n_hit, n_items, items (sorted ids), contaminated."""
    found = cut(hits(docs, items, doc_id, text, item_id, item_text, window).distinct())
    places = found.select("__id", "__th", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p")).distinct()
    n_hit = places.groupBy("__id", "__th").agg(F.count(F.lit(1)).alias("n_hit"))
    ids = found.groupBy("__id", "__th").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    by_doc = cut(n_hit.join(ids, n_hit["__id"].eqNullSafe(ids["__id"]) & (n_hit["__th"] == ids["__th"])).select(n_hit["__id"].alias("__i"), n_hit["__th"].alias("__t"), "n_hit", "items"))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(docs, text)).alias("__th"), F.size(words(text_of(docs, text))).cast("long").alias("n_words"))
    out = slim.join(by_doc, slim["doc_id"].eqNullSafe(F.col("__i")) & (slim["__th"] == F.col("__t")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "__th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    bad = hits(docs, items, doc_id, text, window=window).select(F.col("__id").alias("id_"), F.col("__th").alias("th_")).distinct()
    (id_, th) = spare(docs, "id_", "th_")
    bad = cut(bad.toDF(id_, th))
    (own,) = spare(docs, "own")
    hashed = docs.withColumn(own, F.xxhash64(text_of(docs, text)))
    return hashed.join(bad, hashed[doc_id].eqNullSafe(bad[id_]) & (hashed[own] == bad[th]), "left_anti").drop(own)
