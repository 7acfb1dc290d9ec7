"""Operators over impression logs: sessions, histories, splits, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clicks(imp: DataFrame) -> DataFrame:
    return imp.filter("clicked = 1")


def user_item(imp: DataFrame) -> DataFrame:
    """(user_id, item, weight): watch fractions clipped to [0.01, 1], summed over repeats and capped at 1."""
    w = F.least(F.greatest(F.col("watch_fraction"), F.lit(0.01)), F.lit(1.0))
    return clicks(imp).groupBy("user_id", "item").agg(F.least(F.sum(w), F.lit(1.0)).alias("weight"))


def history(imp: DataFrame, last: int | None = None, half_life: float = 8.0) -> DataFrame:
    """(user_id, item, pos_back, weight, decayed): clicks from the newest back, weights halved every ``half_life`` places."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("session_id"), F.desc("rank_shown"))
    h = clicks(imp).withColumn("pos_back", F.row_number().over(newest) - 1)
    if last is not None:
        h = h.filter(F.col("pos_back") < last)
    w = F.least(F.greatest(F.col("watch_fraction"), F.lit(0.01)), F.lit(1.0))
    return h.select("user_id", "item", "pos_back", w.alias("weight"), (w * F.pow(F.lit(0.5), F.col("pos_back") / half_life)).alias("decayed"))


def cutoff(imp: DataFrame, q: float = 0.8, few: int = 100_000, buckets: int = 4096) -> DataFrame:
    """One row (cutoff): the exact quantile of ts, rounded down to a microsecond.

    Times are counted by range, narrower and narrower, until the range that the quantile falls into holds ``few`` or one time only; nothing else is gathered, whereas Spark's ``percentile`` keeps every
    distinct time in one task.
    """
    ts = imp.select(F.col("ts").cast("long").alias("ts")).filter("ts is not null")
    n, low, high = ts.agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).first()
    kind = "cutoff long"
    if not n:
        return imp.sparkSession.createDataFrame([(None,)], kind)
    at = q * (n - 1)
    first = int(at)
    before, inside = 0, n
    while inside > few and high > low:
        width = -(-(high - low + 1) // buckets)
        counts = ts.filter(F.col("ts").between(low, high)).groupBy(F.floor((F.col("ts") - low) / width).alias("bucket")).count().orderBy("bucket").collect()
        for bucket, inside in counts:
            if before + inside > first:
                break
            before += inside
        low, high = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
    if low == high:
        own, after = low, low if first + 1 < before + inside else None
    else:
        values = sorted(r.ts for r in ts.filter(F.col("ts").between(low, high)).collect())
        own, after = values[first - before], values[first - before + 1] if first - before + 1 < len(values) else None
    if at > first and after is None:
        after = ts.filter(F.col("ts") > high).agg(F.min("ts")).first()[0]
    mid = float(own) if at == first else (first + 1 - at) * own + (at - first) * after
    return imp.sparkSession.createDataFrame([(int(mid // 1),)], kind)


def temporal_split(imp: DataFrame, q: float = 0.8) -> DataFrame:
    return imp.crossJoin(F.broadcast(cutoff(imp, q))).withColumn("is_train", F.col("ts") <= F.col("cutoff")).drop("cutoff")


def user_fold(user: Column, folds: int = 4) -> Column:
    """A fold from integer arithmetic that any engine repeats."""
    return F.pmod(F.pmod(user * 2654435761 + 97, F.lit(1000003)), F.lit(folds)).cast("int")


def hash_order(key: Column, salt: int = 0) -> Column:
    return F.pmod(key * 2654435761 + salt, F.lit(1000003))


def feeds(imp: DataFrame) -> DataFrame:
    """Impressions with feed_seq, numbering each user's distinct times."""
    return imp.withColumn("feed_seq", F.dense_rank().over(Window.partitionBy("user_id").orderBy("ts", "session_id")))


def running_history(imp: DataFrame) -> DataFrame:
    """For each feed (user_id, feed_seq): clicks in it, and the clicks and watched sum of the user's earlier feeds."""
    by = feeds(imp).groupBy("user_id", "feed_seq").agg(F.sum("clicked").alias("n_clicks"), F.sum("watch_fraction").alias("watched"))
    earlier = Window.partitionBy("user_id").orderBy("feed_seq").rowsBetween(Window.unboundedPreceding, -1)
    return by.select("user_id", "feed_seq", F.col("n_clicks").cast("bigint").alias("n_clicks"), F.coalesce(F.sum("n_clicks").over(earlier), F.lit(0)).alias("n_history"), F.coalesce(F.sum("watched").over(earlier), F.lit(0.0)).alias("watched_before"))


def leave_last_n(imp: DataFrame, n: int = 5) -> DataFrame:
    """Clicks with is_test: the last n of each user who has at least n + 5."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("session_id"), F.desc("rank_shown"))
    c = clicks(imp).withColumns({"back": F.row_number().over(newest), "n": F.count(F.lit(1)).over(Window.partitionBy("user_id"))})
    return c.withColumn("is_test", (F.col("n") >= n + 5) & (F.col("back") <= n)).drop("back", "n")
