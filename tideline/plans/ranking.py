"""Stage 2: features, labels, weights and rankers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.shared import written
from tideline.functions.vectors import dot
from tideline.operators import intent, metrics, ranking, recall
from tideline.operators import interactions as ix
from tideline.plans.relational import EHIST, HIST, STATS, stats
from tideline.plans.retrieval import ECOV, ESCORE, PROFILE, SEEN, profiles, reasons
from tideline.registry import query
from tideline.sources.adapters import CAT, EV, IMP, NOW, VEC, catalog, event_impressions, retail_impressions, table, vectors, with_sql


@query(with_sql(*ECOV, VEC, EHIST, ESCORE, SEEN, then="SELECT user_id, cand AS item, max(sim) AS sim FROM rs GROUP BY ALL"))
def sim_max_hist(spark, d):
    return reasons(spark, d).groupBy("user_id", F.col("cand").alias("item")).agg(F.max("sim").alias("sim"))


DUR = "med AS (SELECT user_id, median(duration_seconds / 60.0) AS m, avg(ln(1 + view_count)) AS lv FROM hist JOIN cat ON item = video_id GROUP BY 1)"


def _user_context(spark: SparkSession, d: str) -> DataFrame:
    h = ix.history(retail_impressions(spark, d)).join(catalog(spark, d), F.col("item") == F.col("video_id"))
    return h.groupBy("user_id").agg(F.median(F.col("duration_seconds") / 60.0).alias("m"), F.avg(F.log1p("view_count")).alias("lv"))


@query(with_sql(IMP, CAT, HIST, DUR, then="SELECT imp.user_id, item, session_id, rank_shown, round(-abs(ln(greatest(duration_seconds / 60.0, 0.1) / greatest(coalesce(m, 10.0), 0.5))), 6) AS fit FROM imp JOIN cat ON item = video_id LEFT JOIN med ON med.user_id = imp.user_id"))
def duration_fit(spark, d):
    return _with_context(spark, d).select("user_id", "item", "session_id", F.col("rank_shown").cast("bigint").alias("rank_shown"), F.round("duration_fit", 6).alias("fit"))


def _with_context(spark: SparkSession, d: str) -> DataFrame:
    j = retail_impressions(spark, d).join(catalog(spark, d), F.col("item") == F.col("video_id")).join(_user_context(spark, d), "user_id", "left")
    fit = -F.abs(F.log(F.greatest(F.col("duration_seconds") / 60.0, F.lit(0.1)) / F.greatest(F.coalesce("m", F.lit(10.0)), F.lit(0.5))))
    return j.withColumns({"duration_fit": fit, "views_vs_user": F.log1p("view_count") - F.coalesce("lv", F.lit(0.0))})


@query(with_sql(IMP, CAT, HIST, DUR, then="SELECT imp.user_id, item, session_id, rank_shown, round(ln(1 + view_count) - coalesce(lv, 0), 6) AS vs FROM imp JOIN cat ON item = video_id LEFT JOIN med ON med.user_id = imp.user_id"))
def views_vs_user(spark, d):
    return _with_context(spark, d).select("user_id", "item", "session_id", F.col("rank_shown").cast("bigint").alias("rank_shown"), F.round("views_vs_user", 6).alias("vs"))


AFFS = "ca AS (SELECT user_id, channel_id, sum(decayed) AS channel_affinity FROM hist JOIN cat ON item = video_id GROUP BY ALL), ga AS (SELECT user_id, category, w / sum(w) OVER (PARTITION BY user_id) AS category_affinity FROM (SELECT user_id, category, sum(decayed) AS w FROM hist JOIN cat ON item = video_id GROUP BY ALL))"


def features(spark: SparkSession, d: str) -> DataFrame:
    """Impressions with the item's statistics, duration fit, views against the user's, channel and category affinity.

    Impressions move to their item once and to their user once. What a user has clicked is summed by windows over these rows, so that no history is made beside them and joined back. Users, channels and
    categories that are null have no affinity.
    """
    st = stats(spark, d).select(F.col("video_id").alias("item"), "channel_id", "category", "age_days", "log_views", "engagement_rate", "log_views_per_day", "duration_minutes")
    known, on = F.col("user_id").isNotNull(), F.col("clicked") == 1
    newest = Window.partitionBy("user_id", "clicked").orderBy(F.desc("ts"), F.desc("session_id"), F.desc("rank_shown"))
    watched = F.least(F.greatest(F.col("watch_fraction"), F.lit(0.01)), F.lit(1.0))
    j = retail_impressions(spark, d).join(st, "item").repartition("user_id").withColumn("decayed", F.when(known & on, watched * F.pow(F.lit(0.5), (F.row_number().over(newest) - 1) / 8.0)))
    of_user, mine = Window.partitionBy("user_id"), F.when(known & on, F.lit(1))
    j = j.withColumns({
        "total": F.sum("decayed").over(of_user), "m": F.median(mine * F.col("duration_minutes")).over(of_user), "lv": F.avg(mine * F.col("log_views")).over(of_user),
        "channel_affinity": F.when(F.col("channel_id").isNotNull(), F.sum("decayed").over(Window.partitionBy("user_id", "channel_id"))),
        "category_affinity": F.when(F.col("category").isNotNull(), F.sum("decayed").over(Window.partitionBy("user_id", "category"))) / F.col("total"),
    })
    return j.withColumns({
        "duration_fit": -F.abs(F.log(F.greatest(F.col("duration_minutes"), F.lit(0.1)) / F.greatest(F.coalesce("m", F.lit(10.0)), F.lit(0.5)))),
        "views_vs_user": F.col("log_views") - F.coalesce("lv", F.lit(0.0)),
        "channel_seen": F.col("channel_affinity").isNotNull().cast("int"), **{c: F.coalesce(c, F.lit(0.0)) for c in ("channel_affinity", "category_affinity")},
    }).drop("decayed", "total", "m", "lv")


FEATURES = ["log_views", "engagement_rate", "log_views_per_day", "duration_minutes", "age_days", "duration_fit", "views_vs_user", "channel_affinity", "channel_seen", "category_affinity"]


@query(with_sql(IMP, CAT, NOW, STATS, HIST, DUR, AFFS, then="SELECT i.user_id, i.item, i.session_id, i.rank_shown, round(s.log_views, 6) AS log_views, round(s.engagement_rate, 6) AS engagement_rate, round(coalesce(channel_affinity, 0), 6) AS channel_affinity, (channel_affinity IS NOT NULL)::INT AS channel_seen, round(coalesce(category_affinity, 0), 6) AS category_affinity FROM imp i JOIN stats s ON i.item = s.video_id LEFT JOIN ca ON ca.user_id = i.user_id AND ca.channel_id = s.channel_id LEFT JOIN ga ON ga.user_id = i.user_id AND ga.category = s.category"))
def impression_features(spark, d):
    return features(spark, d).select("user_id", "item", "session_id", F.col("rank_shown").cast("bigint").alias("rank_shown"), *[F.round(c, 6).alias(c) for c in ("log_views", "engagement_rate", "channel_affinity")], "channel_seen", F.round("category_affinity", 6).alias("category_affinity"))


@query(with_sql(IMP, "np AS (SELECT session_id, sum(clicked)::BIGINT AS n_pos FROM imp GROUP BY 1)", "its AS (SELECT p_partkey AS item, row_number() OVER (ORDER BY p_partkey) AS no FROM part)",
    "ng AS (SELECT session_id, item, n, n_pos FROM (SELECT session_id, item, n_pos, row_number() OVER (PARTITION BY session_id ORDER BY (item * 2654435761 + 11) % 1000003, item, rank_shown) AS n FROM imp JOIN np USING (session_id) WHERE clicked = 0))",
    "dr AS (SELECT session_id, (session_id * 2654435761 + i * 40503) % (SELECT count(*) FROM part) + 1 AS no FROM (SELECT session_id, unnest(range(1, 2 * greatest(n_pos, 1) + 1)) AS i FROM np))",
    then="SELECT session_id, item, 1 AS label, 'positive' AS kind FROM imp WHERE clicked = 1 UNION ALL SELECT session_id, item, 0, 'in_feed' FROM ng WHERE n <= 4 * n_pos UNION ALL SELECT session_id, item, 0, 'random' FROM dr JOIN its USING (no)"))
def mixed_negatives(spark, d):
    return ranking.mixed_negatives(retail_impressions(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("item")))


@query(with_sql(IMP, then="SELECT session_id, item, rank_shown, round(CASE WHEN clicked > 0 THEN 1 / greatest(pow(0.82, rank_shown), 0.05) ELSE 1 END, 6) AS weight FROM imp"))
def ips_weights(spark, d):
    return retail_impressions(spark, d).select("session_id", "item", F.col("rank_shown").cast("bigint").alias("rank_shown"), F.round(ranking.ips_weight(F.col("rank_shown"), F.col("clicked")), 6).alias("weight"))


@query(with_sql(IMP, then="SELECT session_id, item, rank_shown, round(CASE WHEN clicked = 1 THEN greatest(watch_seconds / (SELECT median(watch_seconds) FROM imp WHERE clicked = 1), 0.05) ELSE 1.0 END, 6) AS weight FROM imp"))
def watch_time_weights(spark, d):
    imp = retail_impressions(spark, d)
    mid = ix.clicks(imp).agg(F.median("watch_seconds").alias("mid"))
    w = F.when(F.col("clicked") == 1, F.greatest(F.col("watch_seconds") / F.col("mid"), F.lit(0.05))).otherwise(1.0)
    return imp.crossJoin(F.broadcast(mid)).select("session_id", "item", F.col("rank_shown").cast("bigint").alias("rank_shown"), F.round(w, 6).alias("weight"))


@query(with_sql(IMP, then="SELECT session_id, item, rank_shown, clicked AS click, (clicked = 1 AND watch_fraction >= 0.5)::INT AS long_watch, (clicked = 1 AND watch_fraction >= 0.9)::INT AS completion, liked, satisfied, dismissed FROM imp"))
def task_labels(spark, d):
    return retail_impressions(spark, d).select("session_id", "item", F.col("rank_shown").cast("bigint").alias("rank_shown"), *ranking.task_labels())


@query(with_sql(IMP, "cut AS (SELECT floor(quantile_cont(ts, 0.8)) AS c FROM imp)", then="SELECT user_id, item, session_id, rank_shown, ts <= c AS is_train FROM imp, cut"))
def temporal_split(spark, d):
    return ix.temporal_split(retail_impressions(spark, d)).select("user_id", "item", "session_id", F.col("rank_shown").cast("bigint").alias("rank_shown"), "is_train")


@query(with_sql(EV, "f AS (SELECT user_id, item, session_id, (user_id * 2654435761 + 97) % 1000003 % 4 AS fold FROM ev WHERE clicked = 1)", "fs AS (SELECT DISTINCT g.fold, session_id, item FROM f, (SELECT unnest(range(4)) AS fold) g WHERE f.fold <> g.fold)", then="SELECT a.fold::INT AS fold, a.item, b.item AS neighbour, count(*) AS n FROM fs a JOIN fs b ON a.fold = b.fold AND a.session_id = b.session_id AND a.item <> b.item GROUP BY ALL HAVING count(*) >= 2"))
def crossfit_covisit(spark, d):
    """Pair counts for each fold from the other folds' users, in one job keyed by fold."""
    ev = ix.clicks(event_impressions(spark, d)).select("item", "session_id", ix.user_fold(F.col("user_id")).alias("own"))
    keyed = ev.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter("fold <> own").select("fold", "session_id", "item").distinct()
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, (F.col("a.fold") == F.col("b.fold")) & (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.item") != F.col("b.item")))
    return pairs.groupBy(F.col("a.fold").alias("fold"), F.col("a.item").alias("item"), F.col("b.item").alias("neighbour")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query(with_sql(EV, CAT, NOW, STATS, "wm AS (SELECT e.event_id, least(greatest(value / 500.0, 0), 1) AS aff, (log_views - avg(log_views) OVER ()) / nullif(stddev_pop(log_views) OVER (), 0) AS q, duration_minutes, 1 - engagement_rate AS bait, watch_fraction FROM ev e JOIN (SELECT event_id, value FROM events) USING (event_id) JOIN stats ON e.item = video_id)",
    then="SELECT event_id, round(least(greatest((0.30 + 0.45 * aff + 0.12 * tanh(coalesce(q, 0))) * exp(-greatest(duration_minutes - 10.0, 0) / 25.0) * (1 + 0.18 * bait), 0.03), 0.97), 6) AS watch_mean, round(1 / (1 + exp(-(-0.55 + 3.0 * aff + 0.9 * tanh(coalesce(q, 0)) + 1.7 * watch_fraction - 3.4 * bait))), 6) AS satisfied FROM wm"))
def watch_model(spark, d):
    """Expected watch share and satisfaction of every impression, quality being the item's popularity among all impressions and bait what its engagement lacks."""
    e = event_impressions(spark, d).join(table(spark, d, "events").select("event_id", "value"), "event_id").join(stats(spark, d).select(F.col("video_id").alias("item"), "log_views", "duration_minutes", "engagement_rate"), "item")
    level = e.agg(F.avg("log_views").alias("mean"), F.stddev_pop("log_views").alias("spread"))
    e = e.crossJoin(F.broadcast(level)).withColumn("quality", F.coalesce(F.try_divide(F.col("log_views") - F.col("mean"), F.col("spread")), F.lit(0.0)))
    affinity, bait = F.least(F.greatest(F.col("value") / 500.0, F.lit(0.0)), F.lit(1.0)), 1 - F.col("engagement_rate")
    mean = ranking.watch_mean(affinity, F.col("quality"), F.col("duration_minutes"), F.lit(10.0), bait)
    return e.select("event_id", F.round(mean, 6).alias("watch_mean"), F.round(ranking.satisfaction(affinity, F.col("quality"), F.col("watch_fraction"), bait), 6).alias("satisfied"))


@query("SELECT doc_id, round(p / (1 - p), 6) AS odds FROM (SELECT doc_id, least(greatest((n_chars % 1000) / 1000.0, 1e-9), 1 - 1e-9) AS p FROM documents)")
def odds_score(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(ranking.odds((F.col("n_chars") % 1000) / 1000.0), 6).alias("odds"))


HEADS = "h AS (SELECT event_id, clicked * 1.0 AS click, watch_fraction AS long_watch, watch_fraction * watch_fraction AS completion, liked * 1.0 AS liked, satisfied * 1.0 AS satisfied, dismissed * 1.0 AS dismissed FROM ev)"


def heads(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("watch_fraction")
    return event_impressions(spark, d).select("event_id", F.col("clicked").cast("double").alias("click"), w.alias("long_watch"), (w * w).alias("completion"), *[F.col(c).cast("double").alias(c) for c in ("liked", "satisfied", "dismissed")])


@query(with_sql(EV, HEADS, then="SELECT event_id, round(0.10 * click + 0.25 * long_watch + 0.15 * completion + 2.0 * liked + 0.40 * satisfied - 0.20 * dismissed, 6) AS score FROM h"))
def multi_objective(spark, d):
    return heads(spark, d).select("event_id", F.round(ranking.value_score({"liked": 2.0}), 6).alias("score"))


@query(with_sql(EV, HEADS, then="SELECT event_id, task, round(v, 6) AS part FROM (SELECT event_id, unnest(['click', 'long_watch', 'completion', 'liked', 'satisfied', 'dismissed']) AS task, unnest([0.10 * click, 0.25 * long_watch, 0.15 * completion, 0.15 * liked, 0.40 * satisfied, -0.20 * dismissed]) AS v FROM h)"))
def objective_breakdown(spark, d):
    h = heads(spark, d)
    w = F.create_map(*[F.lit(x) for kv in ranking.DEFAULT_WEIGHTS.items() for x in kv])
    return h.unpivot(["event_id"], ranking.TASKS, "task", "v").select("event_id", "task", F.round(F.element_at(w, F.col("task")) * F.col("v"), 6).alias("part"))


@query("SELECT p_partkey, round(coalesce(CASE WHEN p_size % 3 > 0 THEN p_retailprice / 1000 END, 1.0 / (60 + p_size)), 6) AS score FROM part")
def rank_fallback(spark, d):
    ranked = F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice") / 1000)
    return table(spark, d, "part").select("p_partkey", F.round(F.coalesce(ranked, 1 / (60 + F.col("p_size"))), 6).alias("score"))


LAST5 = "l5 AS (SELECT user_id, pos_back, v FROM ehist JOIN vec USING (item) WHERE pos_back < 5), coh AS (SELECT user_id, count(*) AS n, coalesce((SELECT avg(list_inner_product(a.v, b.v)) FROM l5 a JOIN l5 b ON a.user_id = b.user_id AND a.pos_back <> b.pos_back WHERE a.user_id = l5.user_id), 0) AS c FROM l5 GROUP BY 1)"


def _last(spark: SparkSession, d: str) -> DataFrame:
    return ix.history(event_impressions(spark, d)).filter("pos_back < 5").join(vectors(spark, d).select("item", "v"), "item").select("user_id", "pos_back", "v")


@query(with_sql(EV, VEC, EHIST, LAST5, then="SELECT user_id, n, round(least(greatest(c, 0), 1), 6) AS coherence FROM coh"))
def session_coherence(spark, d):
    return metrics.pairwise_mean_cosine(_last(spark, d), ["user_id"]).select("user_id", "n", F.round(intent.clip01(F.col("coherence")), 6).alias("coherence"))


SESS = """
se0 AS (SELECT user_id, p, sum(x * pow(0.5, pos_back / 8.0)) AS s FROM (SELECT user_id, pos_back, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM l5) GROUP BY ALL),
se AS (SELECT user_id, list_transform(l, lambda x: x / greatest(sqrt(list_inner_product(l, l)), 1e-9)) AS session FROM (SELECT user_id, list(s ORDER BY p) AS l FROM se0 GROUP BY 1)),
it AS (SELECT user_id, q, session, least(greatest((least(greatest(c, 0), 1) - 0.07) / 0.16, 0), 1) AS focus, least(greatest(1 - list_inner_product(session, q), 0), 1) AS novelty FROM coh JOIN se USING (user_id) JOIN prof USING (user_id)),
ia AS (SELECT *, least(greatest(focus * (1 + 0.25 * novelty), 0), 1) * 0.8 AS alpha FROM it)
"""
INTENT = (EV, VEC, EHIST, PROFILE, LAST5, SESS)


@query(with_sql(*INTENT, then="SELECT user_id, round(focus, 6) AS focus, round(novelty, 6) AS novelty, round(alpha, 6) AS alpha, alpha > 0.15 AS detected FROM ia"))
def session_intent(spark, d):
    return intent.detect(_last(spark, d), profiles(spark, d)).select("user_id", *[F.round(c, 6).alias(c) for c in ("focus", "novelty", "alpha")], "detected")


@query(with_sql(*INTENT, "b AS (SELECT user_id, list_transform(list_zip(session, q), lambda z: (CASE WHEN alpha > 0.15 THEN alpha ELSE 0 END) * z[1] + (1 - (CASE WHEN alpha > 0.15 THEN alpha ELSE 0 END)) * z[2]) AS v FROM ia)", then="SELECT user_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS b1 FROM b"))
def intent_blend(spark, d):
    return intent.blended(intent.detect(_last(spark, d), profiles(spark, d))).select("user_id", F.round(F.col("blend")[0], 6).alias("b1"))


@query(with_sql(IMP, CAT, HIST, "t AS (SELECT user_id, tag, count(*) AS n FROM (SELECT user_id, unnest([category, channel_id]) AS tag FROM hist JOIN cat ON item = video_id WHERE pos_back < 5) GROUP BY ALL)", "u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tag) AS r FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS top FROM t) WHERE n > 1 OR top = 1)", then="SELECT user_id, string_agg(tag, ', ' ORDER BY r) AS label FROM u WHERE r <= 3 GROUP BY 1"))
def intent_label(spark, d):
    h = ix.history(retail_impressions(spark, d), last=5).join(catalog(spark, d), F.col("item") == F.col("video_id"))
    return intent.label(h.select("user_id", F.explode(F.array("category", "channel_id")).alias("tag")), "user_id", "tag")


DETECTORS = ["coherence", "focus", "novelty", "alpha"]
TRUTH = """
iv AS (SELECT user_id, max(k) AS k, sum(k) AS n FROM (SELECT user_id, category, count(*) AS k FROM ehist JOIN vec USING (item) WHERE pos_back < 5 GROUP BY ALL) GROUP BY 1),
ik AS (SELECT user_id, count(*) AS clicks FROM ehist GROUP BY 1),
ir AS (SELECT u.name || '/' || CASE WHEN clicks >= 25 THEN 'regular' ELSE 'new' END AS detector, round(u.s, 6) AS s, (k >= 2)::INT AS y FROM (SELECT *, unnest([{'name': 'coherence', 's': least(greatest(c, 0), 1)}, {'name': 'focus', 's': focus}, {'name': 'novelty', 's': novelty}, {'name': 'alpha', 's': alpha}]) AS u FROM ia JOIN coh USING (user_id)) JOIN iv USING (user_id) JOIN ik USING (user_id)),
ip AS (SELECT detector, y, rank() OVER (PARTITION BY detector ORDER BY s) + (count(*) OVER (PARTITION BY detector, s) - 1) / 2.0 AS r FROM ir)
"""


@query(with_sql(*INTENT, TRUTH, then="SELECT detector, round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 6) AS auc, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg FROM ip GROUP BY 1"))
def intent_evaluation(spark, d):
    """How well each part of the detector tells sessions whose last five items share a category, which the detector does not see, by how much a user has clicked."""
    h = ix.history(event_impressions(spark, d))
    recent = h.filter("pos_back < 5").join(vectors(spark, d).select("item", "category"), "item").groupBy("user_id", "category").count().groupBy("user_id").agg(F.max("count").alias("k"))
    cohort = F.when(F.col("clicks") >= 25, "regular").otherwise("new")
    found = intent.detect(_last(spark, d), profiles(spark, d)).join(recent, "user_id").join(h.groupBy("user_id").agg(F.count(F.lit(1)).alias("clicks")), "user_id")
    long = found.select(cohort.alias("cohort"), (F.col("k") >= 2).cast("int").alias("y"), *DETECTORS).unpivot(["cohort", "y"], DETECTORS, "name", "s")
    return metrics.auc_by(long.select(F.concat_ws("/", "name", "cohort").alias("detector"), F.round("s", 6).alias("s"), "y"), "detector", "s", "y").select("detector", F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


@query(with_sql(*INTENT, then="SELECT CASE WHEN alpha > 0.15 THEN 'intent' ELSE 'none' END AS cohort, count(*) AS n, round(avg(least(greatest(c, 0), 1)), 6) AS coherence FROM ia JOIN coh USING (user_id) GROUP BY 1"))
def intent_cohort(spark, d):
    """Users by whether an intent was detected: how many, and how coherent."""
    i = intent.detect(_last(spark, d), profiles(spark, d))
    return i.groupBy(F.when(F.col("detected"), "intent").otherwise("none").alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("coherence"), 6).alias("coherence"))


def split_features(spark: SparkSession, d: str) -> DataFrame:
    """``features`` with all task labels, ``is_train``, the first 80 % of time, and ``held``, the tenth of the sessions that stops boosting. They are written once, so that the cutoff and every pass of a fit read columns instead of making them anew."""
    f = features(spark, d).select("session_id", "rank_shown", "ts", *FEATURES, "clicked", *ranking.task_labels())
    return ix.temporal_split(written(f, "features")).withColumn("held", F.pmod(F.xxhash64("session_id"), F.lit(10)) == 0)


@query()
def ranker_train(spark, d):
    """Boosted trees and logistic regression on the first 80 % of time, AUC on the rest, beside the best single feature."""
    f = split_features(spark, d).withColumn("weight", ranking.ips_weight(F.col("rank_shown"), F.col("clicked")))
    train, test = f.filter("is_train"), f.filter("not is_train")
    for kind in ("gbt", "logistic"):
        test = ranking.fit(train, FEATURES, "clicked", "weight", kind, validation="held" if kind == "gbt" else None)(test).withColumnRenamed("probability", kind)
    return _aucs(test, "model", {"gbt": ("gbt", "clicked"), "logistic": ("logistic", "clicked"), "log_views alone": ("log_views", "clicked")})


def _aucs(test: DataFrame, by: str, scores: dict[str, tuple[str, str]]) -> DataFrame:
    """(auc, by): for each name the AUC of its (score, label) columns, all from one pass over ``test``; null where a label is missing."""
    rows = [F.struct(F.lit(n).alias(by), F.col(s).cast("double").alias("s"), F.col(y).alias("y")) for n, (s, y) in scores.items()]
    names = test.sparkSession.createDataFrame([(n,) for n in scores], f"{by} string")
    if not rows:
        return names.select(F.lit(None).cast("double").alias("auc"), by)
    return names.join(metrics.auc_by(written(test.select(F.explode(F.array(*rows)).alias("x")).select("x.*"), "scores"), by, "s", "y"), by, "left").select("auc", by)


@query()
def multitask_heads(spark, d):
    """Each head's AUC on the last fifth of time."""
    f = split_features(spark, d)
    test, models = f.filter("not is_train"), ranking.fit_heads(f.filter("is_train"), FEATURES, validation="held")
    for task, model in models.items():
        test = model(test).withColumnRenamed("probability", f"p_{task}")
    return _aucs(test, "task", {t: (f"p_{t}", t) for t in models})
