"""Metrics, splits for evaluation and the two counterfactual protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators import interactions as ix
from tideline.operators import metrics, recall
from tideline.plans.relational import EHIST
from tideline.plans.retrieval import ECOV, FUSED, RSCORE, candidates
from tideline.registry import query
from tideline.sources.adapters import EV, VEC, event_impressions, table, vectors, with_sql

ECUT = "cut AS (SELECT floor(quantile_cont(ts, 0.8)) AS c FROM ev)"
EPRE = "pre AS (SELECT ev.* FROM ev, cut WHERE ts <= c), post AS (SELECT ev.* FROM ev, cut WHERE ts > c)"
ERECS = "top AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM pre WHERE clicked = 1 GROUP BY item LIMIT 20), recs AS (SELECT user_id, item, rank FROM (SELECT DISTINCT user_id FROM post), top WHERE rank <= 20)"
EREL = "rel AS (SELECT user_id, item, max(watch_fraction) AS gain FROM post WHERE clicked = 1 GROUP BY ALL)"
EALL = (EV, ECUT, EPRE, ERECS, EREL)


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = ix.temporal_split(event_impressions(spark, d))
    return ev.filter("is_train"), ev.filter("not is_train")


def popular_lists(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, item, rank): the 20 items most clicked before the cutoff, for every user seen after it."""
    pre, post = parts(spark, d)
    top = ix.clicks(pre).groupBy("item").count().orderBy(F.desc("count"), "item").limit(20)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "item"))).select("item", "rank")
    return post.select("user_id").distinct().crossJoin(F.broadcast(top))


def relevance(spark: SparkSession, d: str) -> DataFrame:
    return ix.clicks(parts(spark, d)[1]).groupBy("user_id", "item").agg(F.max("watch_fraction").alias("gain"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.list_metrics(popular_lists(spark, d), relevance(spark, d), 10)


J = "j AS (SELECT r.user_id, r.rank, r.item, l.gain, (l.gain IS NOT NULL)::INT AS hit FROM recs r LEFT JOIN rel l ON r.user_id = l.user_id AND r.item = l.item WHERE rank <= 10), users AS (SELECT user_id, count(*) AS n FROM rel GROUP BY 1)"


@query(with_sql(*EALL, J, then="SELECT u.user_id, round(coalesce(sum(hit), 0) / 10.0, 6) AS precision FROM users u LEFT JOIN j USING (user_id) GROUP BY 1"))
def metric_precision(spark, d):
    return _metrics(spark, d).select("user_id", F.round("precision", 6).alias("precision"))


@query(with_sql(*EALL, J, then="SELECT u.user_id, round(coalesce(sum(hit), 0) / max(n), 6) AS recall FROM users u LEFT JOIN j USING (user_id) GROUP BY 1"))
def metric_recall(spark, d):
    return _metrics(spark, d).select("user_id", F.round("recall", 6).alias("recall"))


@query(with_sql(*EALL, J, "h AS (SELECT *, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS hits FROM j)", then="SELECT u.user_id, round(coalesce(sum(hit * hits / rank), 0) / least(max(n), 10), 6) AS ap FROM users u LEFT JOIN h USING (user_id) GROUP BY 1"))
def metric_map(spark, d):
    return _metrics(spark, d).select("user_id", F.round("ap", 6).alias("ap"))


@query(with_sql(*EALL, J, then="SELECT u.user_id, round(coalesce(1.0 / min(rank) FILTER (WHERE hit = 1), 0), 6) AS rr FROM users u LEFT JOIN j USING (user_id) GROUP BY 1"))
def metric_mrr(spark, d):
    return _metrics(spark, d).select("user_id", F.round("rr", 6).alias("rr"))


@query(with_sql(*EALL, J, "i AS (SELECT user_id, sum(gain / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, item) AS p FROM rel) WHERE p <= 10 GROUP BY 1)", then="SELECT i.user_id, round(coalesce(sum(coalesce(gain, 0) / log2(rank + 1)), 0) / max(ideal), 6) AS ndcg FROM i LEFT JOIN j USING (user_id) GROUP BY 1"))
def metric_ndcg(spark, d):
    return _metrics(spark, d).select("user_id", F.round("ndcg", 6).alias("ndcg"))


@query(with_sql(*EALL, J, then="SELECT u.user_id, coalesce(max(hit), 0) AS hit_rate FROM users u LEFT JOIN j USING (user_id) GROUP BY 1"))
def metric_hit_rate(spark, d):
    return _metrics(spark, d).select("user_id", "hit_rate")


@query(with_sql(*EALL, then="SELECT round((SELECT count(DISTINCT item) FROM recs) / (SELECT count(DISTINCT item) FROM ev), 6) AS coverage"))
def metric_coverage(spark, d):
    shown = popular_lists(spark, d).agg(F.countDistinct("item").alias("a"))
    return shown.crossJoin(event_impressions(spark, d).agg(F.countDistinct("item").alias("b"))).select(F.round(F.col("a") / F.col("b"), 6).alias("coverage"))


@query(with_sql(EV, "c AS (SELECT item, coalesce(n, 0) AS x FROM (SELECT DISTINCT item FROM ev) LEFT JOIN (SELECT item, count(*) AS n FROM ev WHERE clicked = 1 GROUP BY 1) USING (item))", "o AS (SELECT x, row_number() OVER (ORDER BY x, item) AS i FROM c)", then="SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1.0) / count(*), 6) AS gini FROM o"))
def metric_gini(spark, d):
    ev = event_impressions(spark, d)
    return metrics.gini(ix.clicks(ev), ev.select("item").distinct()).select(F.round("gini", 6).alias("gini"))


@query(with_sql(*EALL, "p AS (SELECT item, count(*) AS n FROM pre WHERE clicked = 1 GROUP BY 1)", then="SELECT round(avg(-log2(greatest(coalesce(n, 0), 1) / (SELECT sum(n) FROM p))), 6) AS novelty FROM recs LEFT JOIN p USING (item)"))
def metric_novelty(spark, d):
    pop = ix.clicks(parts(spark, d)[0]).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    total = pop.agg(F.sum("n").alias("total"))
    j = popular_lists(spark, d).join(pop, "item", "left").crossJoin(F.broadcast(total))
    return j.agg(F.round(F.avg(-F.log2(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) / F.col("total"))), 6).alias("novelty"))


@query(with_sql(EV, VEC, EHIST, "l AS (SELECT DISTINCT user_id, item, v FROM ehist JOIN vec USING (item) WHERE pos_back < 10)", "x AS (SELECT a.user_id, avg(list_inner_product(a.v, b.v)) AS m FROM l a JOIN l b ON a.user_id = b.user_id AND a.item <> b.item GROUP BY 1)", then="SELECT user_id, round(CASE WHEN m IS NULL THEN 0.0 ELSE 1 - m END, 6) AS diversity FROM (SELECT DISTINCT user_id FROM l) LEFT JOIN x USING (user_id)"))
def metric_ild(spark, d):
    lists = ix.history(event_impressions(spark, d)).filter("pos_back < 10").select("user_id", "item").distinct().join(vectors(spark, d).select("item", "v"), "item")
    c = metrics.pairwise_mean_cosine(lists, ["user_id"])
    return c.select("user_id", F.round(F.when(F.col("n") < 2, 0.0).otherwise(1 - F.col("coherence")), 6).alias("diversity"))


@query(with_sql(*EALL, then="SELECT r.user_id, round(sum((l.gain IS NOT NULL AND r.item NOT IN (SELECT item FROM top WHERE rank <= 5))::INT) / count(*), 6) AS serendipity FROM recs r LEFT JOIN rel l ON r.user_id = l.user_id AND r.item = l.item GROUP BY 1"))
def metric_serendipity(spark, d):
    lists = popular_lists(spark, d)
    obvious = lists.filter("rank <= 5").select("item").distinct().withColumn("obvious", F.lit(1))
    j = metrics.joined(lists, relevance(spark, d)).join(F.broadcast(obvious), "item", "left")
    return j.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("obvious").isNull(), F.col("hit")).otherwise(0)) / F.count(F.lit(1)), 6).alias("serendipity"))


SC = "s AS (SELECT toxic AS y, n_chars % 1000 AS score, 1.0 + doc_id % 3 AS w FROM documents JOIN labels USING (doc_id))"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("toxic").alias("y"), (F.col("n_chars") % 1000).alias("score"), (1.0 + F.col("doc_id") % 3).alias("w"))


@query(with_sql(SC, then="SELECT round((SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) FROM s a, s b WHERE a.y = 1 AND b.y = 0) / ((SELECT count(*) FROM s WHERE y = 1) * (SELECT count(*) FROM s WHERE y = 0)), 6) AS auc"))
def metric_auc(spark, d):
    return metrics.auc(scored(spark, d), "score", "y").select(F.round("auc", 6).alias("auc"))


@query(with_sql(SC, then="SELECT round((SELECT sum(a.w * b.w * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) FROM s a, s b WHERE a.y = 1 AND b.y = 0) / ((SELECT sum(w) FROM s WHERE y = 1) * (SELECT sum(w) FROM s WHERE y = 0)), 6) AS auc"))
def metric_weighted_auc(spark, d):
    return metrics.auc(scored(spark, d), "score", "y", F.col("w")).select(F.round("auc", 6).alias("auc"))


@query(with_sql(SC, then="SELECT round(avg(-(y * ln(least(greatest(score / 1000.0, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(score / 1000.0, 1e-15), 1 - 1e-15)))), 6) AS log_loss FROM s"))
def metric_log_loss(spark, d):
    return scored(spark, d).agg(F.round(metrics.log_loss(F.col("score") / 1000.0, F.col("y")), 6).alias("log_loss"))


@query(with_sql(SC, then="SELECT round(a1, 6) AS auc_length, round(a2, 6) AS auc_weight FROM (SELECT (SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) FROM s a, s b WHERE a.y = 1 AND b.y = 0) AS a1, (SELECT avg(CASE WHEN a.w > b.w THEN 1.0 WHEN a.w = b.w THEN 0.5 ELSE 0 END) FROM s a, s b WHERE a.y = 1 AND b.y = 0) AS a2)"))
def single_feature_auc(spark, d):
    s = scored(spark, d)
    a, b = metrics.auc(s, "score", "y"), metrics.auc(s, "w", "y")
    return a.select(F.round("auc", 6).alias("auc_length")).crossJoin(b.select(F.round("auc", 6).alias("auc_weight")))


FEED = "fd AS (SELECT session_id, item, clicked, round(value, 1) AS score FROM ev JOIN (SELECT event_id, value FROM events) USING (event_id) WHERE session_id IN (SELECT session_id FROM ev GROUP BY 1 HAVING count(*) >= 2))"


@query(with_sql(EV, FEED, "g AS (SELECT session_id, sum(clicked) AS pos, max(score) AS top FROM fd GROUP BY 1)", "t AS (SELECT session_id, max(CASE WHEN score = top AND clicked = 1 THEN 1 ELSE 0 END) / sum((score = top)::INT) AS won FROM fd JOIN g USING (session_id) WHERE pos = 1 GROUP BY 1)", then="SELECT round(avg(won), 6) AS top1, count(*) AS n FROM t"))
def within_group_top1(spark, d):
    return metrics.top1_share(_feed_scores(spark, d), "session_id", "score", "clicked").select(F.round("top1", 6).alias("top1"), "n")


def _feed_scores(spark: SparkSession, d: str) -> DataFrame:
    e = event_impressions(spark, d).join(table(spark, d, "events").select("event_id", F.round("value", 1).alias("score")), "event_id")
    many = e.groupBy("session_id").count().filter("count >= 2")
    return e.join(many, "session_id", "left_semi").select("session_id", "item", "clicked", "score")


@query(with_sql(EV, ECUT, EPRE, "a AS (SELECT user_id, count(*) AS n_pre FROM pre WHERE clicked = 1 GROUP BY 1 HAVING count(*) >= 3)", "b AS (SELECT user_id, count(DISTINCT item) AS n_new FROM post WHERE clicked = 1 AND (user_id, item) NOT IN (SELECT (user_id, item) FROM pre WHERE clicked = 1) GROUP BY 1)", then="SELECT user_id, n_pre, n_new FROM a JOIN b USING (user_id)"))
def eval_users(spark, d):
    pre, post = (ix.clicks(p) for p in parts(spark, d))
    a = pre.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_pre")).filter("n_pre >= 3")
    b = post.join(pre, ["user_id", "item"], "left_anti").groupBy("user_id").agg(F.countDistinct("item").alias("n_new"))
    return a.join(b, "user_id")


REPORT = """
m AS (SELECT u.user_id, coalesce(sum(hit), 0) / 10.0 AS precision, coalesce(max(hit), 0) AS hit_rate FROM users u LEFT JOIN j USING (user_id) GROUP BY 1)
"""


@query(with_sql(*EALL, J, REPORT, then="SELECT 'popularity' AS strategy, round(avg(precision), 6) AS precision, round(avg(hit_rate), 6) AS hit_rate, count(*) AS n_users FROM m"))
def popularity_report(spark, d):
    return _metrics(spark, d).agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("hit_rate"), 6).alias("hit_rate"), F.count(F.lit(1)).alias("n_users")).withColumn("strategy", F.lit("popularity"))


@query(with_sql(*EALL, then="SELECT user_id, item, rank FROM recs"))
def baseline_popularity(spark, d):
    return popular_lists(spark, d).select("user_id", "item", F.col("rank").cast("bigint").alias("rank"))


@query(with_sql(*EALL, "t AS (SELECT item, round(ln(1 + count(*)) * pow(0.5, ((SELECT c FROM cut) - max(ts)) / 86400000000.0 / 7.0), 6) AS s FROM pre GROUP BY 1)", then="SELECT item, s AS score FROM t ORDER BY s DESC, item LIMIT 20"))
def baseline_trending(spark, d):
    pre, _ = parts(spark, d)
    g = pre.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).crossJoin(F.broadcast(ix.cutoff(event_impressions(spark, d))))
    age = (F.col("cutoff") - F.col("last")) / 86_400_000_000.0
    return g.select("item", F.round(F.log(1 + F.col("n")) * F.pow(F.lit(0.5), age / 7.0), 6).alias("score")).orderBy(F.desc("score"), "item").limit(20)


TF = "tf AS (SELECT user_id, session_id, count(*) AS n, sum(clicked) AS n_clicks FROM post GROUP BY ALL HAVING sum(clicked) = 1 AND count(*) >= 2), hi AS (SELECT user_id, count(*) AS n_hist FROM pre WHERE clicked = 1 GROUP BY 1 HAVING count(*) >= 3)"


@query(with_sql(EV, ECUT, EPRE, TF, then="SELECT user_id, session_id, n, n_hist FROM tf JOIN hi USING (user_id)"))
def test_feeds(spark, d):
    return _test_feeds(parts(spark, d))


def _test_feeds(p: tuple[DataFrame, DataFrame]) -> DataFrame:
    pre, post = p
    one = post.groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("clicked").alias("c")).filter("c = 1 and n >= 2").drop("c")
    return one.join(ix.clicks(pre).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_hist")).filter("n_hist >= 3"), "user_id")


@query(with_sql(EV, ECUT, EPRE, TF, "pp AS (SELECT item, count(*) AS s FROM pre WHERE clicked = 1 GROUP BY 1)", "x AS (SELECT p.session_id, clicked, coalesce(s, 0) AS s FROM post p JOIN tf USING (user_id, session_id) JOIN hi USING (user_id) LEFT JOIN pp USING (item))",
    "q AS (SELECT a.session_id, 1.0 + sum((b.s > a.s)::INT) + (sum((b.s = a.s)::INT) - 1) / 2.0 AS r FROM x a JOIN x b USING (session_id) WHERE a.clicked = 1 GROUP BY 1)", then="SELECT count(*) AS feeds, round(avg(1.0 / r), 6) AS mrr, round(avg(1.0 / log2(r + 1)), 6) AS ndcg FROM q"))
def protocol_a(spark, d):
    """Logged feeds re-ranked by popularity; ties take the mean of their places."""
    pre, post = parts(spark, d)
    s = ix.clicks(pre).groupBy("item").agg(F.count(F.lit(1)).alias("s"))
    x = post.join(_test_feeds((pre, post)).select("user_id", "session_id"), ["user_id", "session_id"], "left_semi").join(s, "item", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    by = Window.partitionBy("session_id")
    placed = x.withColumns({"above": F.rank().over(by.orderBy(F.desc("s"))), "ties": F.count(F.lit(1)).over(Window.partitionBy("session_id", "s"))}).filter("clicked = 1")
    r = F.col("above") + (F.col("ties") - 1) / 2.0
    return placed.agg(F.count(F.lit(1)).alias("feeds"), F.round(F.avg(1 / r), 6).alias("mrr"), F.round(F.avg(1 / F.log2(r + 1)), 6).alias("ndcg"))


OBJ = """
ol AS (SELECT CASE source WHEN 'popular' THEN 'popular' ELSE 'covisit' END AS strategy, user_id, item, place + 1 AS rank FROM rk WHERE place < 10
    UNION ALL SELECT 'fused', user_id, item, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(fused, 9) DESC, item) AS r FROM fu) WHERE r <= 10),
oi AS (SELECT user_id, count(*) AS n_relevant, sum(CASE WHEN p <= 10 THEN gain / log2(p + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, item) AS p FROM rel) GROUP BY 1),
om AS (SELECT strategy, user_id, count(gain) AS found, sum(coalesce(gain, 0) / log2(rank + 1)) AS dcg FROM ol LEFT JOIN rel USING (user_id, item) GROUP BY ALL)
"""


@query(with_sql(*ECOV, EHIST, RSCORE.replace("FROM hist", "FROM ehist"), FUSED, ECUT, EPRE, EREL, OBJ, then="SELECT strategy, round(avg(coalesce(dcg / nullif(ideal, 0), 0)), 6) AS ndcg, round(avg(coalesce(found / n_relevant, 0)), 6) AS recall FROM (SELECT s.strategy, oi.*, found, dcg FROM (SELECT DISTINCT strategy FROM ol) s CROSS JOIN oi LEFT JOIN om ON om.strategy = s.strategy AND om.user_id = oi.user_id) GROUP BY 1"))
def objective_compare(spark, d):
    """NDCG of co-visitation, popularity and their fusion over the held-out clicks."""
    rel = relevance(spark, d)
    c = candidates(spark, d)
    out = None
    for name, lists in (("covisit", recall.top_by(c.filter("source = 'covisit'"), "user_id", 10)), ("popular", recall.top_by(c.filter("source = 'popular'"), "user_id", 10)), ("fused", recall.fuse(c, "user_id", most=10))):
        m = metrics.list_metrics(lists.select("user_id", "item", "rank"), rel, 10).agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("recall"), 6).alias("recall")).withColumn("strategy", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out
