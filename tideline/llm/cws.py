"""Consistent weighted sampling fingerprints.

A text is a bag of lower-cased words between ASCII white space, weighted by their counts. For sample k and term x with weight w,
r and c are Gamma(2, 1) and b is uniform, all fixed by (x, k); t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r. The sample is the (x, t) of smallest a, so two bags agree in a sample with a probability
equal to their generalised Jaccard similarity, sum of min weights over sum of max weights.

A sample is one long: ln a in its upper half, a hash of (x, t) in its lower half, so that the smallest is found by a
plain ``min``. Bags without words have no samples: they are alike (1) among themselves and unlike (0) any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, text_of

MASK21 = (1 << 21) - 1
#: ln a is kept from -64 to 64 in steps of 2^-23.
STEPS = float(1 << 23)
#: Samples taken from a row at once.
TOGETHER = 4


def bag(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _uniform(h: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(MASK21)) + 0.5) / float(1 << 21)


def _gamma2(u: Column, v: Column) -> Column:
    return -F.log(u * v)


def _sample(h: Column, log_w: Column, r: Column, log_c: Column, b: Column) -> Column:
    t = F.floor(log_w / r + b)
    log_a = log_c - r * (t - b) - r
    high = F.floor((F.greatest(F.least(log_a, F.lit(63.99)), F.lit(-63.99)) + 64.0) * STEPS)
    return F.shiftleft(high, 32).bitwiseOR(F.xxhash64(h, t).bitwiseAND(F.lit(0xFFFFFFFF)))


def signatures(terms: DataFrame, keys: list[str], term_hash: str, weights: dict[str, str], samples: int = 32) -> DataFrame:
    """(…keys, one array<long> for each weight column): ``terms`` has a row for each key and term; a weight of zero means that the term is absent.

    Each row is taken through the samples ``TOGETHER`` at a time, which keeps the generated code short enough to be compiled.
    """
    logs = [F.when(F.col(w) > 0, F.log(F.col(w).cast("double"))).alias(f"__log_{w}") for w in weights]
    draws = terms.select(*keys, term_hash, *logs).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(samples // TOGETHER - 1))))
    h = F.col(term_hash)
    draws = draws.withColumns({f"__{n}{i}": F.xxhash64(h, F.col("__j"), F.lit(f"{n}{i}")) for i in range(TOGETHER) for n in "pq"})
    made = {}
    for i in range(TOGETHER):
        p, q = F.col(f"__p{i}"), F.col(f"__q{i}")
        made |= {f"__r{i}": _gamma2(_uniform(p, 0), _uniform(p, 21)), f"__c{i}": F.log(_gamma2(_uniform(q, 0), _uniform(q, 21))), f"__b{i}": (F.shiftrightunsigned(p, 42) + F.lit(0.5)) / float(1 << 22)}
    draws = draws.withColumns(made)
    mins = [F.min(_sample(h, F.col(f"__log_{w}"), F.col(f"__r{i}"), F.col(f"__c{i}"), F.col(f"__b{i}"))).alias(f"__{w}_{i}") for w in weights for i in range(TOGETHER)]
    done = draws.groupBy(*keys, "__j").agg(*mins)
    whole = done.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__j", *[F.array(*[F.col(f"__{w}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(TOGETHER)]).alias(w) for w in weights]))).alias("__all"))
    return whole.select(*keys, *[F.when(F.col("__all")[0][w][0].isNotNull(), F.flatten(F.col("__all")[w])).alias(out) for w, out in weights.items()])


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of equal samples; 1 if neither bag has words, 0 if just one has none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / float(samples))


def as_text(signature: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""), F.lit(""))


def fingerprint(docs: DataFrame, keys: list[str], text: str = "text", samples: int = 32) -> DataFrame:
    """(…keys, signature): for distinct keys; bags without words have no row."""
    words = docs.select(*keys, F.explode(bag(text_of(docs, text))).alias("__w")).select(*keys, F.xxhash64("__w").alias("__h"))
    terms = words.groupBy(*keys, "__h").agg(F.count(F.lit(1)).alias("w"))
    return signatures(terms, keys, "__h", {"w": "signature"}, samples)


def edited_text(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many, or all, of the first of ``following``."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_bucket: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, rn, doc_id, text, following) by descending doc_id, and heads (bucket, head): the text that follows a bucket's last row.

    Ranges of doc_id are the buckets: their bounds are quantiles, as many as a few for each shuffle partition. The texts cross the network once.
    """
    spark = docs.sparkSession
    n = per_bucket or 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    bounds = sorted({int(x) for x in docs.approxQuantile(doc_id, [i / n for i in range(1, n)], 0.1 / n)})
    bucket = F.when(F.col(doc_id).isNull(), -1).otherwise(_place(F.col(doc_id), bounds))
    body = docs.select(bucket.alias("bucket"), F.col(doc_id).alias("doc_id"), text_of(docs, text).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text"), F.col("text")]
    w = Window.partitionBy("bucket").orderBy(*order)
    rows = body.withColumns({"rn": F.row_number().over(w), "following": F.lead("text").over(w)})

    tops = docs.select(bucket.alias("bucket"), F.col(doc_id).alias("top")).groupBy("bucket").agg(F.max("top").alias("top"))
    tops = tops.withColumn("before", F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.min("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    firsts = body.join(F.broadcast(tops.withColumnRenamed("bucket", "own")), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = firsts.withColumn("rn", F.row_number().over(Window.partitionBy("own").orderBy(*order[1:]))).filter("rn = 1").select(F.col("before").alias("bucket"), F.col("text").alias("head"))
    return rows, heads


def _place(value: Column, bounds: list[int], lo: int = 0) -> Column:
    """How many of the sorted bounds are below or equal, by halving."""
    if not bounds:
        return F.lit(lo)
    mid = len(bounds) // 2
    if len(bounds) == 1:
        return F.when(value >= bounds[0], lo + 1).otherwise(lo)
    return F.when(value >= bounds[mid], _place(value, bounds[mid + 1 :], lo + mid + 1)).otherwise(_place(value, bounds[:mid], lo))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = 32) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one of next smaller doc_id (null ids last, equal ids by text), after the last the first.
    The texts are dealt out once, by bucket; counting and sampling then need no further shuffle.
    """
    rows, heads = in_order(docs, doc_id, text)
    rows = rows.join(heads, "bucket", "left")
    rows = rows.select("bucket", "rn", "doc_id", "text", F.coalesce("following", "head", "text").alias("following"))
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("following")))
    base = rows.select("bucket", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))

    #: What both texts share up to a word's end is counted once for both.
    kept = F.col("text").substr(F.lit(1), F.length("text") - F.floor(F.length("text") / 3).cast("int"))
    both = F.length(F.regexp_extract(kept, r"(?s)^(.*[\x20\x09-\x0D])", 1))
    parts = rows.select("bucket", "rn", "text", "edited", both.alias("n"))
    three = F.array(
        F.struct(F.lit(1).alias("a"), F.lit(1).alias("b"), bag(F.col("text").substr(F.lit(1), F.col("n"))).alias("ws")),
        F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), bag(F.col("text").substr(F.col("n") + 1, F.length("text"))).alias("ws")),
        F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), bag(F.col("edited").substr(F.col("n") + 1, F.length("edited"))).alias("ws")),
    )
    words = parts.select("bucket", "rn", F.inline(three)).select("bucket", "rn", "a", "b", F.explode("ws").alias("w"))
    terms = words.select("bucket", "rn", "a", "b", F.xxhash64("w").alias("h")).groupBy("bucket", "rn", "h").agg(F.sum("a").alias("wa"), F.sum("b").alias("wb"))
    signed = signatures(terms, ["bucket", "rn"], "h", {"wa": "sig", "wb": "edited_sig"}, samples)

    head_sig = fingerprint(heads, ["bucket"], "head", samples).withColumnRenamed("signature", "head_sig")
    out = base.join(signed, ["bucket", "rn"], "left").join(head_sig, "bucket", "left")
    w = Window.partitionBy("bucket").orderBy("rn")
    out = out.withColumns({"last": F.lead("rn").over(w).isNull(), "lead_sig": F.lead("sig").over(w)})
    out = out.withColumn("next_sig", F.when(F.col("last"), F.col("head_sig")).otherwise(F.col("lead_sig")))
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig"), samples).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig"), samples).alias("near_next"))
