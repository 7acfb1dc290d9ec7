"""Ranking metrics over (key, item, rank) lists, rank from 1, and (key, item, gain) relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.vectors import dot


def joined(recs: DataFrame, relevant: DataFrame, key: str = "user_id") -> DataFrame:
    return recs.join(relevant, [key, "item"], "left").withColumn("hit", F.col("gain").isNotNull().cast("int"))


def list_metrics(recs: DataFrame, relevant: DataFrame, k: int = 10, key: str = "user_id") -> DataFrame:
    """Per key that has relevant items: precision, recall, ap, rr, ndcg, hit_rate at k. Lists and relevance meet in one join, all else is one aggregation."""
    ideal_order = Window.partitionBy(key).orderBy(F.desc("gain"), "item")
    ideal = relevant.withColumn("place", F.row_number().over(ideal_order)).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_relevant"), F.sum(F.when(F.col("place") <= k, F.col("gain") / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("ideal")
    )
    before = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = joined(recs.filter(F.col("rank") <= k), relevant, key).withColumn("hits", F.sum("hit").over(before))
    per = j.groupBy(key).agg(
        F.sum("hit").alias("found"), F.sum(F.col("hit") * F.col("hits") / F.col("rank")).alias("ap"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    at = ideal.join(per, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return at.select(
        key, zero(F.col("found") / F.lit(float(k))).alias("precision"), zero(F.col("found") / F.col("n_relevant")).alias("recall"), zero(F.col("ap") / F.least(F.col("n_relevant"), F.lit(k))).alias("ap"),
        zero(1 / F.col("first")).alias("rr"), zero(F.try_divide(F.col("dcg"), F.col("ideal"))).alias("ndcg"), F.coalesce((F.col("found") > 0).cast("int"), F.lit(0)).alias("hit_rate"),
    )


def gini(exposure: DataFrame, items: DataFrame) -> DataFrame:
    """(gini) of how often each of ``items`` is shown, zeros included."""
    counts = items.select("item").join(exposure.groupBy("item").agg(F.count(F.lit(1)).alias("x")), "item", "left").select("item", F.coalesce("x", F.lit(0)).alias("x"))
    # equal counts may be ranked together: items of one count take consecutive places, whose sum is known
    by = counts.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    ends = by.withColumn("upto", F.sum("c").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    places = (F.col("upto") * 2 - F.col("c") + 1) * F.col("c") / 2.0
    t = ends.agg(F.sum(places * F.col("x")).alias("w"), F.sum(F.col("c") * F.col("x")).alias("s"), F.sum("c").alias("n"))
    return t.select(F.coalesce(F.try_divide(2 * F.col("w"), F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n"), F.lit(0.0)).alias("gini"))


def pairwise_mean_cosine(df: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """(…keys, coherence, n): mean cosine over pairs of unit vectors, from the length of their sum; 0 for fewer than two."""
    parts = df.select(*keys, F.posexplode(vector).alias("p", "x"))
    sums = parts.groupBy(*keys, "p").agg(F.sum("x").alias("s")).groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    own = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(dot(F.col(vector), F.col(vector))).alias("d"))
    n = F.col("n")
    return own.join(sums, keys).select(*keys, F.when(n < 2, 0.0).otherwise((F.col("ss") - F.col("d")) / F.greatest(n * (n - 1), F.lit(1))).alias("coherence"), "n")


def sums_before(df: DataFrame, order: str, value: str, out: str, buckets: int = 64) -> DataFrame:
    """``df`` with the sum of ``value`` over rows of smaller ``order``, whose values differ. Rows are cut into ranges, so that none of the sums runs over the whole table in one task."""
    bounds = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.005)))
    ranged = df.withColumn("__b", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda x: x <= F.col(order))))
    whole = ranged.groupBy("__b").agg(F.sum(value).alias("__s"))
    before = whole.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.join(F.broadcast(before), "__b").withColumn(out, F.col("__before") + F.coalesce(within, F.lit(0.0))).drop("__b", "__before")


def auc(df: DataFrame, score: str, label: str, weight: Column | None = None) -> DataFrame:
    """(auc): weighted chance that a positive outscores a negative, ties half. Rows are summed by score before the running sum."""
    w = F.lit(1.0) if weight is None else weight
    g = df.groupBy(score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0.0).otherwise(w)).alias("n"))
    t = sums_before(g, score, "n", "below").agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t.select(F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("auc"))


def log_loss(p: Column, label: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.avg(-(label * F.log(q) + (1 - label) * F.log(1 - q)))


def top1_share(df: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """(top1, n): expected share of groups with one positive whose best score is its, ties counted by their share."""
    best = Window.partitionBy(key)
    g = df.withColumn("top", F.max(score).over(best)).groupBy(key).agg(F.sum(label).alias("n_pos"), F.count_if(F.col(score) == F.col("top")).alias("ties"), F.max(F.when((F.col(score) == F.col("top")) & (F.col(label) == 1), 1).otherwise(0)).alias("won"))
    return g.filter("n_pos = 1").agg(F.avg(F.col("won") / F.col("ties")).alias("top1"), F.count(F.lit(1)).alias("n"))


def auc_by(df: DataFrame, by: str, score: str, label: str, buckets: int = 64) -> DataFrame:
    """(by, auc, n_pos, n_neg): many AUCs at once, ties half, of rows (by, score, label).

    Rows are summed by score; each group's scores are cut into ranges at its own quantiles, so that no running sum goes over a whole group in one task.
    """
    g = df.groupBy(by, score).agg(F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0.0).otherwise(1.0)).alias("n"))
    bounds = g.groupBy(by).agg(F.array_distinct(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], 1000)).alias("bounds"))
    # a place among the bounds: first among every eighth, then among the eight that follow
    upto = lambda c: F.size(F.filter(c, lambda x: x <= F.col(score)))
    coarse = F.filter("bounds", lambda x, i: i % 8 == 7)
    ranged = g.join(bounds.withColumn("coarse", coarse), by).withColumn("eight", upto(F.col("coarse")) * 8).withColumn("range", F.col("eight") + upto(F.slice("bounds", F.col("eight") + 1, F.lit(8)))).select(by, "range", score, "p", "n")
    # sums of a range are moved up by what lies below the range once the ranges are summed: rows are read once
    within = Window.partitionBy(by, "range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = ranged.withColumn("below", F.coalesce(F.sum("n").over(within), F.lit(0.0)))
    sums = below.groupBy(by, "range").agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    t = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0.0))).groupBy(by).agg(F.sum(F.col("u") + F.col("p") * F.col("start")).alias("u"), F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"))
    return t.select(by, F.try_divide(F.col("u"), F.col("n_pos") * F.col("n_neg")).alias("auc"), F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))


def expected_place(above: Column, ties: Column) -> dict[str, Column]:
    """What a row is worth that shares its score with ``ties`` rows, itself included, below ``above`` others, if ties are broken at random: chance of the first place, mean of 1 / place and of 1 / log2(place + 1)."""
    places = F.sequence(above + 1, above + ties)
    mean = lambda f: F.aggregate(places, F.lit(0.0), lambda s, r: s + f(r)) / ties
    return {"top1": F.when(above == 0, 1 / ties).otherwise(0.0), "mrr": mean(lambda r: 1 / r), "ndcg": mean(lambda r: 1 / F.log2(r + 1))}


def expected_hits(above: Column, ties: Column, k: int) -> dict[str, Column]:
    """Chance of a place among the first ``k``, discounted gain there, and mean place, ties broken at random."""
    inside = F.greatest(F.least(above + ties, F.lit(k)) - above, F.lit(0))
    places = F.when(inside > 0, F.sequence(above + 1, above + inside))
    gain = F.coalesce(F.aggregate(places, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1)), F.lit(0.0)) / ties
    return {"hit_rate": inside / ties, "ndcg": gain, "mean_rank": above + (ties + 1) / 2}


def strategy_metrics(lists: DataFrame, relevant: DataFrame, popularity: DataFrame, vectors: DataFrame, catalog: DataFrame, k: int = 10, obvious: int = 5) -> DataFrame:
    """One row for each strategy of ``lists`` (strategy, user_id, item, rank): all list metrics at ``k`` over users with relevant items, and coverage, Gini, novelty, diversity and serendipity.

    ``relevant``: user_id, item, gain; ``popularity``: item, n; ``vectors``: item, v; ``catalog``: item. Users without a list count as misses. Serendipity counts hits outside the ``obvious`` most popular items.
    """
    users = relevant.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    place = Window.partitionBy("user_id").orderBy(F.desc("gain"), "item")
    ideal = relevant.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k).groupBy("user_id").agg(F.sum(F.col("gain") / F.log2(F.col("place") + 1)).alias("ideal"))
    total = popularity.agg(F.sum("n").alias("total"))
    known = popularity.orderBy(F.desc("n"), "item").limit(obvious).select("item", F.lit(1).alias("known"))
    top = lists.filter(F.col("rank") <= k).join(users.select("user_id"), "user_id", "left_semi")
    hit = top.join(relevant, ["user_id", "item"], "left").join(popularity, "item", "left").join(F.broadcast(known), "item", "left").crossJoin(F.broadcast(total))
    hit = hit.withColumn("hit", F.col("gain").isNotNull().cast("int"))
    upto = Window.partitionBy("strategy", "user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    per = hit.withColumn("hits", F.sum("hit").over(upto)).groupBy("strategy", "user_id").agg(
        F.sum("hit").alias("found"), F.sum(F.col("hit") * F.col("hits") / F.col("rank")).alias("ap"), F.coalesce(F.max(F.col("hit") / F.col("rank")), F.lit(0.0)).alias("rr"),
        F.sum(F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1)).alias("dcg"), F.avg(F.when(F.col("known").isNull(), F.col("hit")).otherwise(0)).alias("serendipity"),
        F.avg(-F.log2(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) / F.col("total"))).alias("novelty"), F.count(F.lit(1)).alias("shown"),
    )
    apart = pairwise_mean_cosine(top.join(vectors, "item"), ["strategy", "user_id"]).select("strategy", "user_id", F.when(F.col("n") < 2, 0.0).otherwise(1 - F.col("coherence")).alias("diversity"))
    each = per.join(users, "user_id").join(ideal, "user_id").join(apart, ["strategy", "user_id"], "left")
    n_users = users.agg(F.count(F.lit(1)).alias("n_users"))
    of_all = lambda c: F.sum(c) / F.first("n_users")
    quality = each.crossJoin(F.broadcast(n_users)).groupBy("strategy").agg(
        of_all(F.col("found") / k).alias("precision"), of_all(F.col("found") / F.col("n_relevant")).alias("recall"), of_all(F.col("ap") / F.least("n_relevant", F.lit(k))).alias("map"), of_all(F.col("rr")).alias("mrr"),
        of_all(F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0))).alias("ndcg"), of_all((F.col("found") > 0).cast("int")).alias("hit_rate"), of_all(F.col("serendipity")).alias("serendipity"),
        (F.sum(F.col("novelty") * F.col("shown")) / F.sum("shown")).alias("novelty"), F.avg(F.coalesce("diversity", F.lit(0.0))).alias("diversity"), F.first("n_users").alias("n_users"),
    )
    size = catalog.agg(F.count(F.lit(1)).alias("size"))
    shown = top.groupBy("strategy", "item").agg(F.count(F.lit(1)).alias("x"))
    # items of one exposure take consecutive places; those never shown take the first ones and add nothing
    by = shown.groupBy("strategy", "x").agg(F.count(F.lit(1)).alias("c"))
    after = Window.partitionBy("strategy").orderBy("x")
    ends = by.withColumns({"upto": F.sum("c").over(after.rowsBetween(Window.unboundedPreceding, 0)), "covered": F.sum("c").over(Window.partitionBy("strategy"))}).crossJoin(F.broadcast(size))
    first = F.col("size") - F.col("covered") + F.col("upto")
    spread = ends.groupBy("strategy").agg(F.sum((first * 2 - F.col("c") + 1) * F.col("c") / 2.0 * F.col("x")).alias("w"), F.sum(F.col("c") * F.col("x")).alias("s"), F.first("size").alias("n"), F.first("covered").alias("covered"))
    spread = spread.select("strategy", (F.col("covered") / F.col("n")).alias("coverage"), (2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))
    return quality.join(spread, "strategy")
