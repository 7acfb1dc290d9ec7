"""Stage 1: retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.shared import written
from tideline.functions.vectors import cosine, dot, l2, weighted_sum
from tideline.operators import catalog as cat
from tideline.operators import interactions as ix
from tideline.operators import recall
from tideline.plans.relational import EHIST, EPAIRS, HIST, PAIRS, STATS, stats
from tideline.registry import query
from tideline.sources.adapters import CAT, EV, IMP, NOW, VEC, catalog, event_impressions, retail_impressions, vectors, with_sql

POP = "pop AS (SELECT item, count(*) AS p FROM s GROUP BY 1)"
NBR = """
nb0 AS (SELECT a.item, a.neighbour, n / (sqrt(p1.p) * sqrt(p2.p)) AS score FROM pairs a JOIN pop p1 ON a.item = p1.item JOIN pop p2 ON a.neighbour = p2.item WHERE n >= 2),
nbr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, neighbour) AS rank FROM nb0) WHERE rank <= 100)
"""
RCOV = (IMP, PAIRS, POP, NBR)
ECOV = (EV, EPAIRS, POP, NBR)


@query(with_sql(*RCOV, then="SELECT item, neighbour, round(score, 6) AS score, rank FROM nbr"))
def covisit_topk(spark, d):
    return recall.covisitation(retail_impressions(spark, d)).select("item", "neighbour", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(with_sql(*ECOV, then="SELECT item, neighbour, round(score, 6) AS score FROM nbr WHERE rank <= 12 AND neighbour >= 10"))
def covisit_similar(spark, d):
    near = recall.covisitation(event_impressions(spark, d))
    seen = spark.range(10).select(F.col("id").alias("neighbour"))
    return near.filter("rank <= 12").join(seen, "neighbour", "left_anti").select("item", "neighbour", F.round("score", 6).alias("score"))


RSCORE = "sc AS (SELECT h.user_id, n.neighbour AS item, sum(n.score * h.decayed) AS score FROM hist h JOIN nbr n ON h.item = n.item GROUP BY ALL)"
CREC = "rec AS (SELECT * FROM (SELECT user_id, item, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item) AS rank FROM sc WHERE (user_id, item) NOT IN (SELECT (user_id, item) FROM hist)) WHERE rank <= 10)"


@query(with_sql(*RCOV, HIST, RSCORE, CREC, then="SELECT user_id, item, round(score, 6) AS score, rank FROM rec"))
def covisit_recommend(spark, d):
    """Top 10 by co-visitation for every user: sessions, pairs, damped neighbours, decayed history, exclusion, top k."""
    imp = retail_impressions(spark, d)
    out = recall.top_by(recall.covisit_scores(ix.history(imp), recall.covisitation(imp)), "user_id", 10)
    return out.select("user_id", "item", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(with_sql(*ECOV, EHIST, RSCORE.replace("FROM hist", "FROM ehist"), then="SELECT user_id, item, round(score, 6) AS score FROM sc WHERE (user_id, item) NOT IN (SELECT (user_id, item) FROM ehist)"))
def covisit_history(spark, d):
    ev = event_impressions(spark, d)
    return recall.covisit_scores(ix.history(ev), recall.covisitation(ev)).select("user_id", "item", F.round("score", 6).alias("score"))


@query(with_sql(*ECOV, EHIST, RSCORE.replace("FROM hist", "FROM ehist").replace("JOIN nbr n ON h.item = n.item", "JOIN nbr n ON h.item = n.item AND n.rank <= 60"), then="SELECT user_id, item, round(score, 6) AS mass FROM sc"))
def covisit_pool(spark, d):
    ev = event_impressions(spark, d)
    return recall.covisit_scores(ix.history(ev), recall.covisitation(ev).filter("rank <= 60"), exclude=False).select("user_id", "item", F.round("score", 6).alias("mass"))


@query(with_sql(VEC, "q AS (SELECT item AS query, v AS q FROM vec WHERE item % 100 = 0)", "x AS (SELECT query, item, list_inner_product(q, v) AS score FROM q, vec WHERE item <> query)", then="SELECT query, item, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, item) AS rank FROM x) WHERE rank <= 10"))
def vector_topk(spark, d):
    v = vectors(spark, d)
    queries = v.filter("item % 100 = 0").select(F.col("item").alias("query"), F.col("v").alias("q"))
    out = recall.top_by(recall.blocked_topk(queries, v, "query", 11).filter("item <> query"), "query", 10)
    return out.select("query", "item", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(with_sql(VEC, then="SELECT item, round(list_cosine_similarity((SELECT v FROM vec WHERE item = 7), v), 6) AS score FROM vec WHERE item <> 7 ORDER BY score DESC, item LIMIT 20"))
def content_similar(spark, d):
    v = vectors(spark, d)
    one = v.filter("item = 7").select(F.col("v").alias("q"))
    scored = v.filter("item <> 7").crossJoin(F.broadcast(one)).select("item", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "item").limit(20)


PROFILE = """
pr0 AS (SELECT user_id, p, sum(x * decayed) AS s FROM (SELECT user_id, decayed, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM ehist JOIN vec USING (item)) GROUP BY ALL),
prof AS (SELECT user_id, list_transform(l, lambda x: x / greatest(sqrt(list_inner_product(l, l)), 1e-9)) AS q FROM (SELECT user_id, list(s ORDER BY p) AS l FROM pr0 GROUP BY 1))
"""


def profiles(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(ix.history(event_impressions(spark, d)), vectors(spark, d))


def _profiles(history: DataFrame, vectors: DataFrame) -> DataFrame:
    h = history.join(vectors, "item")
    return weighted_sum(h, ["user_id"], "v", F.col("decayed"), "q").withColumn("q", l2(F.col("q")))


@query(with_sql(EV, VEC, EHIST, PROFILE, then="SELECT user_id, round(q[1], 6) AS q1, round(q[64], 6) AS q64 FROM prof"))
def taste_profile(spark, d):
    return profiles(spark, d).select("user_id", F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[63], 6).alias("q64"))


@query(with_sql(EV, VEC, EHIST, PROFILE, "near AS (SELECT user_id, item, list_inner_product(q, v) AS score FROM prof, vec)", "last AS (SELECT h.user_id, b.item, 0.85 * list_inner_product(a.v, b.v) AS score FROM ehist h JOIN vec a ON a.item = h.item, vec b WHERE pos_back = 0 AND b.item <> h.item)",
    "u AS (SELECT user_id, item, max(score) AS score FROM (SELECT * FROM near UNION ALL SELECT * FROM last) WHERE (user_id, item) NOT IN (SELECT (user_id, item) FROM ehist) GROUP BY ALL)", then="SELECT user_id, item, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item) AS rank FROM u) WHERE rank <= 10"))
def content_history(spark, d):
    h = written(ix.history(event_impressions(spark, d)), "history")
    items = vectors(spark, d).select("item", "v")
    seen = h.groupBy("user_id").agg((F.countDistinct("item") + 10).alias("need"))
    near = recall.blocked_topk(_profiles(h, vectors(spark, d)).join(seen, "user_id"), items, "user_id", F.col("need"))
    # users with the same newest item ask the same: each item is asked for once, as deep as any of them needs
    newest = h.filter("pos_back = 0").select("user_id", F.col("item").alias("newest")).join(seen, "user_id")
    asked = newest.groupBy("newest").agg(F.max("need").alias("need")).join(items.withColumnRenamed("item", "newest"), "newest").select("newest", F.transform("v", lambda x: 0.85 * x).alias("q"), "need")
    found = recall.blocked_topk(asked, items, "newest", F.col("need"))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("newest").orderBy(F.desc(F.round("score", 6)), "item")))
    last = newest.join(found, "newest").filter("place <= need").select("user_id", "item", "score")
    best = near.unionByName(last).groupBy("user_id", "item").agg(F.max("score").alias("score")).join(h, ["user_id", "item"], "left_anti")
    return recall.top_by(best, "user_id", 10).select("user_id", "item", F.round("score", 6).alias("score"))


ESCORE = RSCORE.replace("FROM hist", "FROM ehist")
SEEN = """
rc AS (SELECT user_id, item FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item) AS n FROM sc WHERE (user_id, item) NOT IN (SELECT (user_id, item) FROM ehist)) WHERE n <= 10),
rs AS (SELECT DISTINCT h.user_id, h.item AS hist_item, c.item AS cand, round(list_inner_product(a.v, c.v), 6) AS sim FROM rc JOIN ehist h USING (user_id) JOIN vec a ON a.item = h.item JOIN vec c ON c.item = rc.item)
"""


def reasons(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, cand, hist_item, sim): every user's ten recommendations by co-visitation beside each item of the user's history."""
    ev = event_impressions(spark, d)
    h, v = ix.history(ev), vectors(spark, d).select("item", "v")
    rec = recall.top_by(recall.covisit_scores(h, recall.covisitation(ev)), "user_id", 10).select("user_id", "item").join(v, "item").select("user_id", F.col("item").alias("cand"), "v")
    seen = h.select("user_id", "item").distinct().join(v, "item").select("user_id", F.col("item").alias("hist_item"), F.col("v").alias("h"))
    return rec.join(seen, "user_id").select("user_id", "cand", "hist_item", F.round(dot(F.col("h"), F.col("v")), 6).alias("sim"))


@query(with_sql(*ECOV, VEC, EHIST, ESCORE, SEEN, then="SELECT user_id, cand, hist_item, sim FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cand ORDER BY sim DESC, hist_item) AS n FROM rs) WHERE n = 1"))
def nearest_reason(spark, d):
    best = reasons(spark, d).groupBy("user_id", "cand").agg(F.max(F.struct("sim", (-F.col("hist_item")).alias("m"))).alias("b"))
    return best.select("user_id", "cand", (-F.col("b.m")).alias("hist_item"), F.col("b.sim").alias("sim"))


def _sim_max(spark: SparkSession, d: str) -> DataFrame:
    return nearest_reason(spark, d).select("user_id", "cand", "sim")


@query(with_sql(CAT, NOW, STATS, "t AS (SELECT video_id, round(log_views_per_day * pow(0.5, age_days / 21.0) * (1 + 2 * engagement_rate), 6) AS score FROM stats)", then="SELECT video_id, score FROM t ORDER BY score DESC, video_id LIMIT 60"))
def trending(spark, d):
    return stats(spark, d).select("video_id", F.round(cat.trending_score(), 6).alias("score")).orderBy(F.desc("score"), "video_id").limit(60)


@query(with_sql(CAT, NOW, STATS, "t AS (SELECT video_id, round(log_views * (1 + 1.5 * engagement_rate), 6) AS score FROM stats)", then="SELECT video_id, score FROM t ORDER BY score DESC, video_id LIMIT 60"))
def popular(spark, d):
    return stats(spark, d).select("video_id", F.round(cat.popular_score(), 6).alias("score")).orderBy(F.desc("score"), "video_id").limit(60)


AFF = "aff AS (SELECT user_id, channel_id, sum(decayed) AS affinity FROM hist JOIN cat ON item = video_id GROUP BY ALL)"


def affinity(spark: SparkSession, d: str, by: str) -> DataFrame:
    h = ix.history(retail_impressions(spark, d)).join(catalog(spark, d).select(F.col("video_id").alias("item"), by), "item")
    return h.groupBy("user_id", by).agg(F.sum("decayed").alias("affinity"))


@query(with_sql(IMP, CAT, NOW, STATS, HIST, AFF, "c AS (SELECT a.user_id, video_id AS item, affinity * (1 + 0.15 * ln(1 + log_views * (1 + 1.5 * engagement_rate))) AS score FROM aff a JOIN stats USING (channel_id) )", then="SELECT user_id, item, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item) AS n FROM c WHERE (user_id, item) NOT IN (SELECT (user_id, item) FROM hist)) WHERE n <= 20"))
def channel_recall(spark, d):
    """Twenty new items of each user's channels; no user is crossed with whole channels."""
    best = recall.channel_topk(affinity(spark, d, "channel_id"), stats(spark, d), cat.popular_score(), ix.history(retail_impressions(spark, d)), 20)
    return best.select("user_id", "item", F.round("score", 6).alias("score"))


@query(with_sql(IMP, CAT, HIST, "a AS (SELECT user_id, category, sum(decayed) AS w FROM hist JOIN cat ON item = video_id GROUP BY ALL)", then="SELECT user_id, category, round(w / sum(w) OVER (PARTITION BY user_id), 6) AS share FROM a"))
def category_affinity(spark, d):
    from pyspark.sql import Window

    a = affinity(spark, d, "category")
    return a.select("user_id", "category", F.round(F.col("affinity") / F.sum("affinity").over(Window.partitionBy("user_id")), 6).alias("share"))


FUSED = """
src AS (SELECT user_id, 'covisit' AS source, item, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item) AS n FROM sc) WHERE n <= 30
    UNION ALL SELECT user_id, 'popular', item, p FROM (SELECT DISTINCT user_id FROM ehist), (SELECT item, p FROM pop ORDER BY p DESC, item LIMIT 30)),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY round(score, 6) DESC, item) - 1 AS place FROM src),
fu AS (SELECT user_id, item, sum(CASE source WHEN 'covisit' THEN 1.15 ELSE 1.0 END / (60.0 + place + 1)) AS fused, count(*) AS n_sources, string_agg(source, '+' ORDER BY source) AS sources FROM rk GROUP BY ALL)
"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, source, item, score): co-visitation and popularity for every user of the events, whose sessions are cut once."""
    ev = written(event_impressions(spark, d), "impressions")
    h = ix.history(ev)
    near = recall.top_by(recall.covisit_scores(h, recall.covisitation(ev), exclude=False), "user_id", 30).select("user_id", F.lit("covisit").alias("source"), "item", "score")
    top = recall.sessions(ev).groupBy("item").agg(F.count(F.lit(1)).cast("double").alias("score")).orderBy(F.desc("score"), "item").limit(30)
    return near.unionByName(h.select("user_id").distinct().crossJoin(F.broadcast(top)).select("user_id", F.lit("popular").alias("source"), "item", "score"))


@query(with_sql(*ECOV, EHIST, RSCORE.replace("FROM hist", "FROM ehist"), FUSED, then="SELECT user_id, item, round(fused, 6) AS fused, n_sources, sources FROM fu"))
def rrf_fusion(spark, d):
    f = recall.fuse(candidates(spark, d), "user_id")
    return f.select("user_id", "item", F.round("fused", 6).alias("fused"), F.size("sources").cast("bigint").alias("n_sources"), F.array_join(F.map_keys("sources"), "+").alias("sources"))


@query(with_sql(*ECOV, EHIST, RSCORE.replace("FROM hist", "FROM ehist"), FUSED, then="SELECT user_id, item, place AS covisit_rank FROM rk WHERE source = 'covisit' AND place < 3"))
def provenance(spark, d):
    f = recall.fuse(candidates(spark, d), "user_id")
    at = F.element_at("sources", "covisit")["rank"]
    return f.select("user_id", "item", at.cast("bigint").alias("covisit_rank")).filter("covisit_rank < 3")


@query(with_sql(EV, "u AS (SELECT user_id, count(*) FILTER (WHERE clicked = 1) AS n FROM ev GROUP BY 1)", then="SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'search' WHEN user_id % 10 = 1 THEN 'watch_page' WHEN n > 0 THEN 'personalised' ELSE 'cold_start' END AS mode, CASE WHEN user_id % 10 = 0 THEN 'content+trending' WHEN user_id % 10 = 1 THEN 'content+covisit+trending' WHEN n > 0 THEN 'content+covisit+als+channel+trending' ELSE 'trending+popular' END AS sources FROM u"))
def recall_router(spark, d):
    from tideline.operators.policy import request_mode, routed_sources

    u = event_impressions(spark, d).groupBy("user_id").agg(F.count_if(F.col("clicked") == 1).alias("n"))
    mode = request_mode(F.col("user_id") % 10 == 0, F.col("user_id") % 10 == 1, F.col("n") > 0)
    return u.select("user_id", mode.alias("mode"), F.array_join(routed_sources(mode), "+").alias("sources"))


def _als(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ui = ix.user_item(event_impressions(spark, d))
    users, items = recall.ImplicitALS(factors=8, iterations=3).fit(ui)
    return ui, users, items


@query()
def als_fit(spark, d):
    _, users, items = _als(spark, d)
    return users.withColumn("side", F.lit("user")).unionByName(items.withColumn("side", F.lit("item")))


@query()
def als_rmse(spark, d):
    ui, users, items = _als(spark, d)
    j = ui.join(users.select(F.col("id").alias("user_id"), F.col("y").alias("u")), "user_id").join(items.select(F.col("id").alias("item"), F.col("y").alias("i")), "item")
    return j.agg(F.sqrt(F.avg(F.pow(1 - dot(F.col("u"), F.col("i")), F.lit(2)))).alias("rmse"), F.count(F.lit(1)).alias("n"))


@query()
def als_foldin(spark, d):
    ui, _, items = _als(spark, d)
    return recall.ImplicitALS(factors=8).fold_in(ui, items)


@query()
def als_recommend(spark, d):
    ui, users, items = _als(spark, d)
    need = ui.groupBy(F.col("user_id").alias("id")).agg((F.count(F.lit(1)) + 10).alias("need"))
    asked = users.join(need, "id").select(F.col("id").alias("user_id"), F.col("y").alias("q"), "need")
    scored = recall.blocked_topk(asked, items.select(F.col("id").alias("item"), F.col("y").alias("v")), "user_id", F.col("need"))
    return recall.top_by(scored.join(ui, ["user_id", "item"], "left_anti"), "user_id", 10)


@query()
def als_similar(spark, d):
    _, _, items = _als(spark, d)
    q = items.filter("id % 100 = 0").select(F.col("id").alias("query"), l2(F.col("y")).alias("q"))
    scored = recall.blocked_topk(q, items.select(F.col("id").alias("item"), l2(F.col("y")).alias("v")), "query", 11)
    return recall.top_by(scored.filter("item <> query"), "query", 10)
