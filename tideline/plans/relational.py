"""Scans, projections, filters, joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators import catalog as cat
from tideline.operators import interactions as ix
from tideline.registry import query
from tideline.sources.adapters import CAT, EV, IMP, NOW, VEC, catalog, event_impressions, now_us, retail_impressions, table, vectors, with_sql

STATS = """
st0 AS (SELECT cat.*, CASE WHEN published IS NULL THEN 365.0 ELSE greatest((now - published) / 86400000000.0, 0.0) END AS age_days, ln(1 + greatest(view_count, 0)::DOUBLE) AS log_views,
    CASE WHEN view_count = 0 THEN 0.0 ELSE least(greatest(like_count::DOUBLE / view_count, 0.0), 1.0) END AS like_rate,
    CASE WHEN view_count = 0 THEN 0.0 ELSE least(greatest(comment_count::DOUBLE / view_count, 0.0), 1.0) END AS comment_rate FROM cat, nw),
stats AS (SELECT *, least(greatest(like_rate + 5 * comment_rate, 0.0), 1.0) AS engagement_rate, view_count / greatest(age_days, 1.0) AS views_per_day,
    ln(1 + view_count / greatest(age_days, 1.0)) AS log_views_per_day, duration_seconds / 60.0 AS duration_minutes FROM st0)
"""


def stats(spark: SparkSession, d: str) -> DataFrame:
    return cat.item_stats(catalog(spark, d).crossJoin(F.broadcast(now_us(spark, d))), F.col("now"))


HIST = "hist AS (SELECT user_id, item, pos_back, w AS weight, w * pow(0.5, pos_back / 8.0) AS decayed FROM (SELECT user_id, item, least(greatest(watch_fraction, 0.01), 1.0) AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, session_id DESC, rank_shown DESC) - 1 AS pos_back FROM imp WHERE clicked = 1))"
EHIST = HIST.replace("hist AS", "ehist AS").replace("FROM imp", "FROM ev")


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_size > 10")
def scan_catalog(spark, d):
    return table(spark, d, "part").filter("p_size > 10").select("p_partkey", "p_name", "p_brand", "p_size")


@query("SELECT p_partkey AS video_id, p_name AS title, p_brand AS channel_title FROM part")
def alias_resolution(spark, d):
    return cat.resolve_aliases(table(spark, d, "part"), {"video_id": ["video_id", "id", "p_partkey"], "title": ["title", "p_name", "p_type"], "channel_title": ["channel", "p_brand"], "views": ["view_count"]})


@query("SELECT p_partkey AS video_id, coalesce(try_cast(p_name AS BIGINT), 0) AS view_count, coalesce(p_brand, '') AS channel_id, 0.0::DOUBLE AS latent_quality FROM part")
def coerce_schema(spark, d):
    df = table(spark, d, "part").select(F.col("p_partkey").alias("video_id"), F.col("p_name").alias("view_count"), F.col("p_brand").alias("channel_id"), "p_size")
    return cat.coerce(df, {"video_id": ("bigint", 0), "view_count": ("bigint", 0), "channel_id": ("string", ""), "latent_quality": ("double", 0.0)})


@query("SELECT p_name AS video_id, p_type AS title, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) n FROM part WHERE p_name <> '') WHERE n = 1 AND length(trim(p_type)) > 0")
def clean_catalog(spark, d):
    return cat.clean_catalog(table(spark, d, "part").select(F.col("p_name").alias("video_id"), F.col("p_type").alias("title"), "p_partkey"), "video_id", "title", "p_partkey")


@query(with_sql(CAT, NOW, STATS, then="SELECT video_id, round(age_days, 6) AS age_days, round(log_views, 6) AS log_views, round(like_rate, 6) AS like_rate, round(comment_rate, 6) AS comment_rate, round(engagement_rate, 6) AS engagement_rate, round(log_views_per_day, 6) AS log_views_per_day, (duration_seconds <= 75)::INT AS is_short, length(title) AS title_length FROM stats"))
def item_stats(spark, d):
    six = [F.round(c, 6).alias(c) for c in ("age_days", "log_views", "like_rate", "comment_rate", "engagement_rate", "log_views_per_day")]
    return stats(spark, d).select("video_id", *six, "is_short", F.col("title_length").cast("bigint").alias("title_length"))


@query(with_sql(IMP, then="SELECT user_id, item, session_id FROM imp WHERE clicked = 1"))
def click_filter(spark, d):
    return ix.clicks(retail_impressions(spark, d)).select("user_id", "item", "session_id")


@query("SELECT p_partkey AS video_id, concat_ws(' . ', p_name, p_brand, p_type, substr(p_name || ' ' || p_type, 1, 20)) AS doc FROM part")
def item_text(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("video_id"), F.concat_ws(" . ", "p_name", "p_brand", "p_type", F.substring(F.concat_ws(" ", "p_name", "p_type"), 1, 20)).alias("doc"))


@query("SELECT p_partkey AS video_id FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def category_filter(spark, d):
    part = table(spark, d, "part")
    return part.join(F.broadcast(part.agg(F.min("p_type").alias("p_type"))), "p_type").select(F.col("p_partkey").alias("video_id"))


@query("SELECT p_partkey AS video_id, p_name AS title FROM part WHERE regexp_matches(p_name, '(?i)(red|steel|small)')")
def title_regex(spark, d):
    return table(spark, d, "part").filter(F.col("p_name").rlike("(?i)(red|steel|small)")).select(F.col("p_partkey").alias("video_id"), F.col("p_name").alias("title"))


@query(with_sql(IMP, then="SELECT DISTINCT user_id, item FROM imp WHERE item IN (SELECT p_partkey FROM part WHERE p_size <= 25)"))
def history_semi_join(spark, d):
    known = table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("item"))
    return retail_impressions(spark, d).join(known, "item", "left_semi").select("user_id", "item").distinct()


@query(with_sql(CAT, then="SELECT video_id, title, channel_id, category, duration_seconds, view_count FROM cat"))
def serving_projection(spark, d):
    return catalog(spark, d).select("video_id", "title", "channel_id", "category", "duration_seconds", "view_count")


@query(with_sql(IMP, then="SELECT user_id, item, round(least(sum(least(greatest(watch_fraction, 0.01), 1.0)), 1.0), 6) AS weight FROM imp WHERE clicked = 1 GROUP BY ALL"))
def user_item_matrix(spark, d):
    return ix.user_item(retail_impressions(spark, d)).withColumn("weight", F.round("weight", 6))


PAIRS = "s AS (SELECT DISTINCT session_id, item FROM imp WHERE clicked = 1), pairs AS (SELECT a.item AS item, b.item AS neighbour, count(*) AS n FROM s a JOIN s b ON a.session_id = b.session_id AND a.item <> b.item GROUP BY ALL)"
EPAIRS = PAIRS.replace("FROM imp", "FROM ev")


@query(with_sql(IMP, PAIRS, then="SELECT item, neighbour, n FROM pairs"))
def covisit_counts(spark, d):
    from tideline.operators.recall import pair_counts

    return pair_counts(retail_impressions(spark, d))


@query(with_sql(EV, then="SELECT u.user_id, i.item FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN (SELECT item, count(*) n FROM ev GROUP BY item ORDER BY n DESC, item LIMIT 20) i WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_id = u.user_id AND ev.item = i.item)"))
def exclude_history(spark, d):
    ev = event_impressions(spark, d)
    top = ev.groupBy("item").count().orderBy(F.desc("count"), "item").limit(20).select("item")
    return ev.select("user_id").distinct().crossJoin(F.broadcast(top)).join(ev, ["user_id", "item"], "left_anti")


@query(with_sql(EV, "cut AS (SELECT floor(quantile_cont(ts, 0.8)) AS c FROM ev)", then="SELECT DISTINCT user_id, item FROM ev, cut WHERE clicked = 1 AND ts > c AND (user_id, item) NOT IN (SELECT (user_id, item) FROM ev, cut WHERE ts <= c)"))
def holdout_unseen(spark, d):
    ev = ix.temporal_split(event_impressions(spark, d))
    return ix.clicks(ev).filter("not is_train").join(ev.filter("is_train"), ["user_id", "item"], "left_anti").select("user_id", "item").distinct()


@query(with_sql(IMP, then="SELECT user_id, item, session_id FROM imp WHERE user_id IN (SELECT user_id FROM imp WHERE clicked = 1 GROUP BY 1 HAVING count(*) >= 30)"))
def active_users_semi(spark, d):
    imp = retail_impressions(spark, d)
    active = ix.clicks(imp).groupBy("user_id").count().filter("count >= 30")
    return imp.join(active, "user_id", "left_semi").select("user_id", "item", "session_id")


@query(with_sql(EV, "f AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY ts, session_id) AS feed_seq FROM ev)", "g AS (SELECT user_id, feed_seq, sum(clicked)::BIGINT AS n_clicks, sum(watch_fraction) AS watched FROM f GROUP BY ALL)", then="SELECT user_id, feed_seq, n_clicks, coalesce(sum(n_clicks) OVER w, 0)::BIGINT AS n_history, round(coalesce(sum(watched) OVER w, 0), 6) AS watched_before FROM g WINDOW w AS (PARTITION BY user_id ORDER BY feed_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def causal_history(spark, d):
    return ix.running_history(event_impressions(spark, d)).withColumns({"watched_before": F.round("watched_before", 6), "feed_seq": F.col("feed_seq").cast("bigint")})


@query(with_sql(IMP, then="SELECT session_id, min(user_id) AS user_id FROM imp GROUP BY 1"))
def session_user(spark, d):
    return retail_impressions(spark, d).groupBy("session_id").agg(F.min("user_id").alias("user_id"))


@query(with_sql(EV, then="SELECT user_id, item, clicked, satisfied FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) n FROM ev) WHERE n = 1"))
def first_outcome(spark, d):
    first = Window.partitionBy("user_id", "item").orderBy("ts", "event_id")
    return event_impressions(spark, d).withColumn("n", F.row_number().over(first)).filter("n = 1").select("user_id", "item", "clicked", "satisfied")


@query(with_sql(IMP, then="SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item) AS n_items, count(DISTINCT session_id) AS n_sessions, sum(clicked)::BIGINT AS n_clicks, round(avg(clicked), 6) AS ctr, round(sum(clicked) / count(DISTINCT user_id), 6) AS clicks_per_user, round(sum(satisfied) / sum(clicked), 6) AS satisfaction FROM imp"))
def log_summary(spark, d):
    users = F.countDistinct("user_id")
    return retail_impressions(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), users.alias("n_users"), F.countDistinct("item").alias("n_items"), F.countDistinct("session_id").alias("n_sessions"), F.sum("clicked").alias("n_clicks"), F.round(F.avg("clicked"), 6).alias("ctr"), F.round(F.sum("clicked") / users, 6).alias("clicks_per_user"), F.round(F.sum("satisfied") / F.sum("clicked"), 6).alias("satisfaction"))


@query(with_sql(IMP, then="SELECT rank_shown, count(*) AS n, round(avg(clicked), 6) AS ctr FROM imp GROUP BY 1"))
def ctr_by_position(spark, d):
    return retail_impressions(spark, d).groupBy(F.col("rank_shown").cast("bigint").alias("rank_shown")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("clicked"), 6).alias("ctr"))


@query(with_sql(IMP, then="SELECT user_id, count(*) AS n FROM imp WHERE clicked = 1 GROUP BY 1 HAVING count(*) >= 20"))
def active_users(spark, d):
    return ix.clicks(retail_impressions(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")


@query(with_sql(IMP, then="SELECT item, count(DISTINCT session_id) AS popularity FROM imp WHERE clicked = 1 GROUP BY 1"))
def item_popularity(spark, d):
    """Pairs of session and item are told apart in parts of about 250,000 rows by session, so that no task holds more of them as tables grow."""
    parts = max(1, -(-table(spark, d, "lineitem").count() // 250_000))
    pairs = ix.clicks(retail_impressions(spark, d)).select("session_id", "item").repartition(parts, "session_id").distinct()
    return pairs.groupBy("item").agg(F.count(F.lit(1)).alias("popularity"))


@query("SELECT count(DISTINCT p_brand) AS channels, count(DISTINCT p_type) AS categories FROM part")
def distinct_counts(spark, d):
    return table(spark, d, "part").agg(F.countDistinct("p_brand").alias("channels"), F.countDistinct("p_type").alias("categories"))


@query("SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1")
def category_counts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


@query("SELECT p_brand AS channel_id, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, channel_id LIMIT 1")
def largest_channel(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("channel_id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "channel_id").limit(1)


@query(with_sql(IMP, "cut AS (SELECT floor(quantile_cont(ts, 0.8))::BIGINT AS c FROM imp)", then="SELECT c AS cutoff, count(*) FILTER (WHERE ts <= c) AS n_train, count(*) FILTER (WHERE ts > c) AS n_test FROM imp, cut GROUP BY c"))
def temporal_cutoff(spark, d):
    imp = retail_impressions(spark, d)
    return imp.crossJoin(F.broadcast(ix.cutoff(imp))).groupBy("cutoff").agg(F.count_if(F.col("ts") <= F.col("cutoff")).alias("n_train"), F.count_if(F.col("ts") > F.col("cutoff")).alias("n_test"))


@query("SELECT p_type AS category, median(p_size * 60)::DOUBLE AS median_duration FROM part GROUP BY 1")
def median_duration(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.median(F.col("p_size") * 60).alias("median_duration"))


@query("SELECT p_partkey AS video_id, CASE WHEN p_size <= 5 THEN coalesce(m, 600.0) ELSE p_size * 60.0 END::DOUBLE AS duration FROM part LEFT JOIN (SELECT p_type AS t, median(p_size * 60)::DOUBLE AS m FROM part WHERE p_size > 5 GROUP BY 1) ON p_type = t")
def impute_duration(spark, d):
    part = table(spark, d, "part")
    known = part.filter("p_size > 5").groupBy("p_type").agg(F.median(F.col("p_size") * 60).alias("m"))
    return part.join(F.broadcast(known), "p_type", "left").select(F.col("p_partkey").alias("video_id"), F.when(F.col("p_size") <= 5, F.coalesce("m", F.lit(600.0))).otherwise((F.col("p_size") * 60).cast("double")).alias("duration"))


@query(with_sql(CAT, then="SELECT video_id, round(CASE WHEN s > 0 THEN (view_count - m) / s ELSE 0 END, 6) AS z FROM cat, (SELECT avg(view_count) AS m, stddev_pop(view_count) AS s FROM cat)"))
def zscore_views(spark, d):
    return cat.zscore(catalog(spark, d), "view_count", "z").select("video_id", F.round("z", 6).alias("z"))


@query(with_sql(CAT, then="SELECT round(corr(like_count, comment_count), 6) AS r FROM cat"))
def corr_bait_like(spark, d):
    return catalog(spark, d).agg(F.round(F.corr("like_count", "comment_count"), 6).alias("r"))


@query(with_sql(CAT, then="SELECT round(sum(CASE WHEN n <= 20 THEN view_count ELSE 0 END) / sum(view_count), 6) AS top_share FROM (SELECT view_count, row_number() OVER (ORDER BY view_count DESC, video_id) AS n FROM cat)"))
def top_share(spark, d):
    items = catalog(spark, d)
    top = items.orderBy(F.desc("view_count"), "video_id").limit(20).agg(F.sum("view_count").alias("top"))
    return items.agg(F.sum("view_count").alias("all")).crossJoin(top).select(F.round(F.col("top") / F.col("all"), 6).alias("top_share"))


@query(with_sql(IMP, then="SELECT user_id, session_id, dense_rank() OVER (PARTITION BY user_id ORDER BY ts, session_id) AS feed_seq, rank_shown FROM imp"))
def feed_segments(spark, d):
    return ix.feeds(retail_impressions(spark, d)).select("user_id", "session_id", F.col("feed_seq").cast("bigint").alias("feed_seq"), F.col("rank_shown").cast("bigint").alias("rank_shown"))


@query(with_sql(IMP, HIST, then="SELECT user_id, item, pos_back, round(decayed, 6) AS decayed FROM hist"))
def recency_decay(spark, d):
    return ix.history(retail_impressions(spark, d)).select("user_id", "item", F.col("pos_back").cast("bigint").alias("pos_back"), F.round("decayed", 6).alias("decayed"))


@query(with_sql(IMP, HIST, then="SELECT user_id, item, pos_back FROM hist WHERE pos_back < 5"))
def last_n_window(spark, d):
    return ix.history(retail_impressions(spark, d), last=5).select("user_id", "item", F.col("pos_back").cast("bigint").alias("pos_back"))


@query(with_sql(IMP, HIST, then="SELECT user_id, item FROM hist WHERE pos_back = 0"))
def recent_item(spark, d):
    newest = F.struct("ts", "session_id", "rank_shown")
    return ix.clicks(retail_impressions(spark, d)).groupBy("user_id").agg(F.max_by("item", newest).alias("item"))


@query(with_sql(IMP, then="SELECT session_id, rank_shown, round(CASE WHEN n = 1 THEN 1.0 ELSE 1 - (r - 1)::DOUBLE / (n - 1) END, 6) AS normal FROM (SELECT session_id, rank_shown, row_number() OVER (PARTITION BY session_id ORDER BY rank_shown) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM imp)"))
def rank_normalise(spark, d):
    from tideline.operators.policy import rank_normalised

    return retail_impressions(spark, d).select("session_id", F.col("rank_shown").cast("bigint").alias("rank_shown"), F.round(rank_normalised(["session_id"], F.col("rank_shown")), 6).alias("normal"))


@query("SELECT p_name, p_partkey FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) n FROM part) WHERE n = 1")
def dedup_peak(spark, d):
    peak = Window.partitionBy("p_name").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("n", F.row_number().over(peak)).filter("n = 1").select("p_name", "p_partkey")


@query(with_sql(IMP, "c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, session_id DESC, rank_shown DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n FROM imp WHERE clicked = 1)", then="SELECT user_id, item, session_id, (n >= 10 AND back <= 5) AS is_test FROM c"))
def leave_last_n(spark, d):
    return ix.leave_last_n(retail_impressions(spark, d)).select("user_id", "item", "session_id", "is_test")


@query(with_sql(IMP, then="SELECT user_id, item, session_id, rank_shown FROM imp ORDER BY user_id, ts, session_id, rank_shown LIMIT 500"))
def feed_order(spark, d):
    return retail_impressions(spark, d).orderBy("user_id", "ts", "session_id", "rank_shown").limit(500).select("user_id", "item", "session_id", F.col("rank_shown").cast("bigint").alias("rank_shown"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def nlargest(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query(with_sql(CAT, then="SELECT video_id, view_count FROM cat ORDER BY view_count DESC, video_id LIMIT 40 OFFSET 80"))
def mid_popular_slice(spark, d):
    return catalog(spark, d).orderBy(F.desc("view_count"), "video_id").offset(80).limit(40).select("video_id", "view_count")


@query("SELECT c_custkey AS id, 'a' AS part FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'b' FROM customer WHERE c_custkey % 3 = 0")
def union_folds(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return c.filter("id % 2 = 0").withColumn("part", F.lit("a")).unionByName(c.filter("id % 3 = 0").withColumn("part", F.lit("b")))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || '| |' || p_type || '|' || p_name, '|'), lambda x: trim(x)), lambda x: x <> '')[1:2], ',') AS tags FROM part")
def tags_distinct(spark, d):
    joined = F.concat_ws("|", "p_name", F.lit(" "), "p_type", "p_name")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(cat.split_tags(joined)), ",").alias("tags"))


@query(with_sql(IMP, HIST, "l AS (SELECT user_id, list(DISTINCT item) FILTER (WHERE pos_back < 10) AS a, list(DISTINCT item) FILTER (WHERE pos_back >= 5) AS b FROM hist GROUP BY 1)", then="SELECT user_id, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS common, len(coalesce(a, [])) - len(list_intersect(coalesce(a, []), coalesce(b, []))) AS only_new FROM l"))
def list_overlap(spark, d):
    h = ix.history(retail_impressions(spark, d))
    g = h.groupBy("user_id").agg(F.collect_set(F.when(F.col("pos_back") < 10, F.col("item"))).alias("a"), F.collect_set(F.when(F.col("pos_back") >= 5, F.col("item"))).alias("b"))
    return g.select("user_id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("common"), F.size(F.array_except("a", "b")).cast("bigint").alias("only_new"))


@query("SELECT c_custkey FROM customer ORDER BY (c_custkey * 2654435761 + 7) % 1000003, c_custkey LIMIT 50")
def hash_sample(spark, d):
    return table(spark, d, "customer").orderBy(ix.hash_order(F.col("c_custkey"), 7), "c_custkey").limit(50).select("c_custkey")


@query("SELECT c_custkey AS user_id, ((c_custkey * 2654435761 + 97) % 1000003 % 4)::INT AS fold FROM customer")
def user_folds(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), ix.user_fold(F.col("c_custkey")).alias("fold"))


@query(with_sql(VEC, then="SELECT item, round(list_inner_product(u, u), 6) AS squared, round(u[1], 6) AS first FROM (SELECT item, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-9)) AS u FROM (SELECT item, list_transform(v, lambda x: 3 * x) AS v FROM vec))"))
def l2_normalise(spark, d):
    from tideline.functions.vectors import dot, l2

    v = vectors(spark, d).select("item", l2(F.transform("v", lambda x: 3 * x)).alias("u"))
    return v.select("item", F.round(dot(F.col("u"), F.col("u")), 6).alias("squared"), F.round(F.col("u")[0], 6).alias("first"))


@query(with_sql(CAT, "m AS (SELECT coalesce(median(least(like_count::DOUBLE / view_count, 0.25)), 0.02) AS m FROM cat WHERE view_count > 0 AND like_count > 0)", then="SELECT video_id, round(coalesce(least(greatest(least(like_count::DOUBLE / nullif(view_count, 0), 0.25) / m, 0.15), 6.0), 1.0), 6) AS quality FROM cat, m"))
def latent_quality_proxy(spark, d):
    rate = F.least(F.try_divide(F.col("like_count").cast("double"), F.col("view_count")), F.lit(0.25))
    items = catalog(spark, d).withColumn("r", rate)
    mid = items.filter("r > 0").agg(F.coalesce(F.median("r"), F.lit(0.02)).alias("m"))
    quality = F.when(F.col("r").isNull(), 1.0).otherwise(F.least(F.greatest(F.col("r") / F.col("m"), F.lit(0.15)), F.lit(6.0)))
    return items.crossJoin(F.broadcast(mid)).select("video_id", F.round(quality, 6).alias("quality"))


@query("SELECT category, term, n FROM (SELECT p_type AS category, p_brand AS term, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1, 2) WHERE r <= 3")
def taxonomy_queries(spark, d):
    best = Window.partitionBy("category").orderBy(F.desc("n"), "term")
    g = table(spark, d, "part").groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("r", F.row_number().over(best)).filter("r <= 3").drop("r")


@query(with_sql(CAT, "b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY view_count DESC, video_id) AS r FROM cat)", then="SELECT category, video_id FROM (SELECT category, video_id, row_number() OVER (PARTITION BY category ORDER BY (video_id * 2654435761 + 5) % 1000003, video_id) AS n FROM b WHERE r > 40 AND r <= 120) WHERE n <= 8"))
def personas(spark, d):
    top = Window.partitionBy("category").orderBy(F.desc("view_count"), "video_id")
    draw = Window.partitionBy("category").orderBy(ix.hash_order(F.col("video_id"), 5), "video_id")
    band = catalog(spark, d).withColumn("r", F.row_number().over(top)).filter("r > 40 and r <= 120")
    return band.withColumn("n", F.row_number().over(draw)).filter("n <= 8").select("category", "video_id")


@query("SELECT o_orderkey, (o_orderkey % 90) * 60 + o_orderkey % 60 AS seconds FROM orders")
def iso_duration(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("PT"), F.col("o_orderkey") % 90, F.lit("M"), F.col("o_orderkey") % 60, F.lit("S")).alias("iso"))
    return o.select("o_orderkey", cat.iso_seconds(F.col("iso")).alias("seconds"))


@query("SELECT item_id, CASE WHEN length(text) <= 42 THEN text ELSE rtrim(substr(text, 1, 41)) || '…' END AS short FROM benchmark")
def title_truncation(spark, d):
    return table(spark, d, "benchmark").select("item_id", cat.short_title(F.col("text")).alias("short"))


@query("SELECT DISTINCT p_brand, 'UC' || substr(md5(p_brand), 1, 20) AS channel_id FROM part")
def surrogate_ids(spark, d):
    return table(spark, d, "part").select("p_brand", cat.surrogate_id(F.col("p_brand")).alias("channel_id")).distinct()


@query(with_sql(NOW, then="SELECT now FROM nw"))
def reference_now(spark, d):
    return now_us(spark, d)
