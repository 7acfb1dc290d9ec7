"""The driver's tables as catalog, impressions, histories and vectors.

Impressions have one row for each item shown: user_id, item, session_id, ts (microseconds), rank_shown, clicked, watch_fraction,
watch_seconds, liked, satisfied, dismissed. The retail adapter reads orders, the events adapter cuts sessions where a user pauses for over a day.
Each adapter has its DuckDB twin, a list of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _outcomes(df: DataFrame, liked: Column, satisfied: Column) -> DataFrame:
    on = F.col("clicked") == 1
    return df.withColumns({
        "liked": (on & liked).cast("int"),
        "satisfied": (on & satisfied).cast("int"),
        "dismissed": (on & (F.col("watch_fraction") < 0.12)).cast("int"),
    })


def retail_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    df = line.withColumn("rank_shown", F.row_number().over(order) - 1)
    df = df.join(orders, df.l_orderkey == orders.o_orderkey).join(part, df.l_partkey == part.p_partkey)
    df = df.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("session_id"), micros(F.col("o_orderdate")).alias("ts"), "rank_shown",
        (F.col("l_returnflag") != "R").cast("int").alias("clicked"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 50.0).otherwise(0.0).alias("watch_fraction"),
        (F.col("p_size") * 60).cast("double").alias("duration"), "l_discount", "l_linestatus",
    )
    df = _outcomes(df, F.col("l_discount") >= 0.05, F.col("l_linestatus") == "F")
    return df.withColumn("watch_seconds", F.col("watch_fraction") * F.col("duration")).drop("l_discount", "l_linestatus", "duration")


IMP = """
imp0 AS (SELECT o_custkey AS user_id, l_partkey AS item, l_orderkey AS session_id, epoch_us(o_orderdate) AS ts,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS rank_shown,
    (l_returnflag <> 'R')::INT AS clicked, CASE WHEN l_returnflag <> 'R' THEN l_quantity / 50.0 ELSE 0.0 END AS watch_fraction,
    (p_size * 60)::DOUBLE AS duration, l_discount, l_linestatus
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
imp AS (SELECT user_id, item, session_id, ts, rank_shown, clicked, watch_fraction, watch_fraction * duration AS watch_seconds,
    (clicked = 1 AND l_discount >= 0.05)::INT AS liked, (clicked = 1 AND l_linestatus = 'F')::INT AS satisfied,
    (clicked = 1 AND watch_fraction < 0.12)::INT AS dismissed FROM imp0)
"""


def event_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", micros(F.col("ts")).alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("item"))
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.col("ts") - F.lag("ts").over(by_user)
    e = e.withColumn("__new", F.when(pause.isNull() | (pause > DAY_US), 1).otherwise(0))
    e = e.withColumn("__n", F.sum("__new").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("session_id", F.concat_ws("-", "user_id", "__n"))
    e = e.withColumns({
        "rank_shown": F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")) - 1,
        "clicked": F.col("event_type").isin("click", "purchase").cast("int"),
    })
    e = e.withColumn("watch_fraction", F.when(F.col("clicked") == 1, F.least(F.col("value") / 500.0, F.lit(1.0))).otherwise(0.0))
    e = _outcomes(e, F.col("event_type") == "purchase", F.col("watch_fraction") >= 0.3)
    return e.withColumn("watch_seconds", F.col("watch_fraction") * 600.0).drop("__new", "__n", "event_type", "value")


EV = """
ev0 AS (SELECT event_id, user_id, epoch_us(ts) AS ts, event_type, value, json_extract_string(props, '$.k')::BIGINT AS item FROM events),
ev1 AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > 86400000000 THEN 1 ELSE 0 END AS nw FROM ev0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ev2 AS (SELECT *, concat(user_id, '-', (sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT) AS session_id FROM ev1),
ev3 AS (SELECT event_id, user_id, ts, item, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS rank_shown, event_type,
    (event_type IN ('click', 'purchase'))::INT AS clicked, CASE WHEN event_type IN ('click', 'purchase') THEN least(value / 500.0, 1.0) ELSE 0.0 END AS watch_fraction FROM ev2),
ev AS (SELECT event_id, user_id, item, session_id, ts, rank_shown, clicked, watch_fraction, watch_fraction * 600.0 AS watch_seconds, (event_type = 'purchase')::INT AS liked,
    (clicked = 1 AND watch_fraction >= 0.3)::INT AS satisfied, (clicked = 1 AND watch_fraction < 0.12)::INT AS dismissed FROM ev3)
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    seen = line.join(orders, line.l_orderkey == orders.o_orderkey).groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("view_count"), F.count_if(F.col("l_returnflag") == "A").alias("like_count"), F.count_if(F.col("l_returnflag") == "N").alias("comment_count"), F.min(micros(F.col("o_orderdate"))).alias("published")
    )
    df = part.join(seen, part.p_partkey == seen.l_partkey, "left")
    return df.select(
        F.col("p_partkey").alias("video_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("channel_id"), F.col("p_type").alias("category"), (F.col("p_size") * 60).cast("bigint").alias("duration_seconds"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("view_count", "like_count", "comment_count")], "published",
    )


CAT = """
cat AS (SELECT p_partkey AS video_id, p_name AS title, p_brand AS channel_id, p_type AS category, (p_size * 60)::BIGINT AS duration_seconds,
    coalesce(v, 0) AS view_count, coalesce(l, 0) AS like_count, coalesce(c, 0) AS comment_count, published
    FROM part LEFT JOIN (SELECT l_partkey, count(*) AS v, count(*) FILTER (WHERE l_returnflag = 'A') AS l, count(*) FILTER (WHERE l_returnflag = 'N') AS c, min(epoch_us(o_orderdate)) AS published
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON p_partkey = l_partkey)
"""


def now_us(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (now): a day after the last order."""
    return table(spark, sf_dir, "orders").agg((F.max(micros(F.col("o_orderdate"))) + DAY_US).alias("now"))


NOW = "nw AS (SELECT max(epoch_us(o_orderdate)) + 86400000000 AS now FROM orders)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").alias("category"))


VEC = "vec AS (SELECT vec_id AS item, embedding::DOUBLE[] AS v, label AS category FROM embeddings)"


def with_sql(*parts: str, then: str) -> str:
    """A query of common table expressions; each is named once even where several parts bring it."""
    return "WITH " + ",\n".join(p.strip() for p in dict.fromkeys(parts)) + "\n" + then
