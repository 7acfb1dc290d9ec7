"""Stage 3: page policy, explanations and materialised pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.shared import written
from tideline.operators import catalog as cat
from tideline.operators import interactions as ix
from tideline.operators import policy, recall
from tideline.operators.metrics import pairwise_mean_cosine
from tideline.plans.relational import EHIST, STATS, stats
from tideline.plans.retrieval import ECOV, FUSED, RSCORE, candidates
from tideline.registry import query
from tideline.sources.adapters import CAT, EV, NOW, VEC, catalog, event_impressions, vectors, with_sql

ERS = RSCORE.replace("FROM hist", "FROM ehist")


@query(with_sql(CAT, NOW, STATS, then="SELECT video_id, round(1 + 0.08 * pow(0.5, greatest(age_days, 0) / 21.0), 6) AS boost FROM stats"))
def freshness(spark, d):
    return stats(spark, d).select("video_id", F.round(cat.freshness(F.col("age_days")), 6).alias("boost"))


@query(with_sql(*ECOV, EHIST, ERS, then="SELECT user_id, item, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item % 20 ORDER BY round(score, 6) DESC, item) AS n FROM sc) WHERE n <= 2"))
def channel_cap(spark, d):
    ev = event_impressions(spark, d)
    s = recall.covisit_scores(ix.history(ev), recall.covisitation(ev), exclude=False).withColumn("channel", F.col("item") % 20)
    return policy.capped(s, "user_id", "channel", 2).select("user_id", "item", F.round("score", 6).alias("score"))


def page_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Fused candidates with what the page policy needs."""
    f = recall.fuse(candidates(spark, d), "user_id", most=60)
    base = policy.rank_normalised(["user_id"], F.col("rank"))
    j = f.withColumn("base", base).join(vectors(spark, d), "item")
    pop = event_impressions(spark, d).groupBy("item").agg(F.count(F.lit(1)).alias("p"))
    total = pop.agg(F.sum("p").alias("t"))
    j = j.join(pop, "item").crossJoin(F.broadcast(total))
    draw = (F.pmod(F.col("item") * 2654435761 + F.col("user_id") * 7919, F.lit(1000003)) + 1) / 1000004.0
    return j.select("user_id", "item", "base", "v", "category", (F.col("item") % 20).alias("channel"), (-F.log2(F.col("p") / F.col("t"))).alias("surprise"), draw.alias("draw"), "sources")


@query(with_sql("RECURSIVE " + VEC.strip(), "c AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY req ORDER BY rel DESC, item) AS place FROM (SELECT p.p_partkey % 5 AS req, v.item, v.v, v.category, v.item % 20 AS ch, round((v.item * 37 % 101) / 101.0, 6) AS rel FROM (SELECT p_partkey FROM part WHERE p_partkey < 5) p, vec v WHERE v.item % 5 >= p.p_partkey % 5 - 2)) WHERE place <= 40)",
    "s AS (SELECT DISTINCT req, 0 AS k, [-1::BIGINT] AS picked FROM c UNION ALL SELECT req, k, picked FROM (SELECT s.req, s.k + 1 AS k, list_append(s.picked, c.item) AS picked, row_number() OVER (PARTITION BY s.req ORDER BY round(0.72 * c.rel - 0.28 * greatest(0, coalesce((SELECT max(0.75 * list_inner_product(b.v, c.v) + 0.25 * (b.category = c.category)::INT) FROM vec b WHERE list_contains(s.picked, b.item)), 0)), 9) DESC, c.rel DESC, c.item) AS n FROM s JOIN c ON c.req = s.req WHERE s.k < 6 AND NOT list_contains(s.picked, c.item) AND len(list_filter(s.picked[2:], lambda x: x % 20 = c.ch)) < 2) WHERE n = 1)",
    then="SELECT req, unnest(picked[2:]) AS item, generate_subscripts(picked[2:], 1)::INT - 1 AS position FROM s WHERE k = 6"))
def mmr_page(spark, d):
    req = spark.range(5).select(F.col("id").alias("req"))
    best = Window.partitionBy("req").orderBy(F.desc("base"), "item")
    c = vectors(spark, d).crossJoin(F.broadcast(req)).filter("item % 5 >= req - 2").select("req", "item", F.round((F.col("item") * 37 % 101) / 101.0, 6).alias("base"), "v", "category", (F.col("item") % 20).alias("channel"), F.lit(1.0).alias("surprise"), F.lit(0.5).alias("draw"))
    c = c.withColumn("place", F.row_number().over(best)).filter("place <= 40").drop("place")
    return policy.page(c, "req", policy.Policy(k=6, slots=0)).select("req", "item", "position")


@query(with_sql(*ECOV, EHIST, ERS, FUSED, "fz AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(fused, 9) DESC, item) AS r FROM fu)", "b AS (SELECT user_id, item, r, CASE WHEN n = 1 THEN 1.0 ELSE 1 - (r - 1)::DOUBLE / (n - 1) END AS base FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM fz WHERE r <= 60))", then="SELECT user_id, item FROM (SELECT *, median(base) OVER (PARTITION BY user_id) AS m FROM b) WHERE r > 18 AND base >= m"))
def exploration_pool(spark, d):
    """Candidates beyond the page's 18 best that are at least as relevant as the median."""
    w = Window.partitionBy("user_id")
    f = recall.fuse(candidates(spark, d), "user_id", most=60)
    f = f.withColumn("base", policy.rank_normalised(["user_id"], F.col("rank")))
    return f.withColumn("m", F.median("base").over(w)).filter((F.col("rank") > 18) & (F.col("base") >= F.col("m"))).select("user_id", "item")


@query()
def page_policy(spark, d):
    return policy.page(page_candidates(spark, d).drop("sources"), "user_id")


@query()
def policy_sweep(spark, d):
    """Diversity and exposure of pages by the weight of relevance: mean distance within pages, the share of all items that some page shows, and the Gini coefficient of how often each item is shown, never included."""
    weights = [0.5, 0.72, 0.9, 1.0]
    m = policy.coherences(page_candidates(spark, d).drop("sources"), "user_id", [policy.Policy(k=10, mmr=w, slots=0) for w in weights])
    m = exposure(m, vectors(spark, d).count())
    return spark.createDataFrame(list(enumerate(weights)), "policy int, mmr double").join(m, "policy", "left").select("diversity", "coverage", "gini", "mmr")


def exposure(pages: DataFrame, catalog: int) -> DataFrame:
    """(policy, diversity, coverage, gini) of (policy, coherence, items) over ``catalog`` items. Pages are read once; items of a policy that are shown equally often take consecutive places, whose sum is known."""
    first = F.col("pos") == 0
    shown = pages.select("policy", (1 - F.col("coherence")).alias("apart"), F.posexplode("items").alias("pos", "item"))
    of_item = shown.groupBy("policy", "item").agg(F.count(F.lit(1)).alias("x"), F.sum(F.when(first, F.col("apart"))).alias("apart"), F.count_if(first).alias("pages"))
    equal = of_item.groupBy("policy", "x").agg(F.count(F.lit(1)).alias("c"), F.sum("apart").alias("apart"), F.sum("pages").alias("pages"))
    whole = Window.partitionBy("policy")
    upto = F.sum("c").over(whole.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    equal = equal.withColumns({"upto": upto + catalog - F.sum("c").over(whole)})
    places = (F.col("upto") * 2 - F.col("c") + 1) * F.col("c") / 2.0
    sums = equal.groupBy("policy").agg(F.sum("apart").alias("apart"), F.sum("pages").alias("pages"), F.sum("c").alias("items"), F.sum(places * F.col("x")).alias("w"), F.sum(F.col("c") * F.col("x")).alias("s"))
    n = F.lit(float(catalog))
    return sums.select("policy", (F.col("apart") / F.col("pages")).alias("diversity"), (F.col("items") / n).alias("coverage"), (2 * F.col("w") / (n * F.col("s")) - (n + 1) / n).alias("gini"))


@query()
def explanation_json(spark, d):
    f = recall.fuse(candidates(spark, d), "user_id", most=24)
    return f.select("user_id", "item", F.to_json(F.struct(F.round("fused", 6).alias("score"), "sources")).alias("detail"))


@query(with_sql(*ECOV, EHIST, ERS, FUSED, VEC, then="SELECT user_id, f.item, category, round(fused, 4) AS score, n_sources FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(fused, 9) DESC, item) AS r FROM fu) f JOIN vec ON f.item = vec.item WHERE r <= 10"))
def materialise(spark, d):
    f = recall.fuse(candidates(spark, d), "user_id", most=10).join(vectors(spark, d).select("item", "category"), "item")
    return f.select("user_id", "item", "category", F.round("fused", 4).alias("score"), F.size("sources").cast("bigint").alias("n_sources"))


@query(with_sql(EV, then="SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 'search' WHEN user_id % 10 = 1 THEN 'watch_page' WHEN sum(clicked) > 0 THEN 'personalised' ELSE 'cold_start' END AS mode FROM ev GROUP BY 1"))
def request_mode(spark, d):
    u = event_impressions(spark, d).groupBy("user_id").agg(F.sum("clicked").alias("n"))
    return u.select("user_id", policy.request_mode(F.col("user_id") % 10 == 0, F.col("user_id") % 10 == 1, F.col("n") > 0).alias("mode"))


MIX = "mx AS (SELECT user_id, string_agg(category || ':' || n, ', ' ORDER BY n DESC, category) AS category_mix FROM (SELECT user_id, category, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1)"


@query(with_sql(*ECOV, EHIST, ERS, FUSED, VEC, CAT, NOW, STATS, "t AS (SELECT user_id, f.item, vec.category, v, age_days, p FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(fused, 9) DESC, item) AS r FROM fu) f JOIN vec ON f.item = vec.item JOIN stats ON f.item = video_id LEFT JOIN pop ON pop.item = f.item WHERE r <= 10)", MIX,
    "dv AS (SELECT a.user_id, 1 - avg(list_inner_product(a.v, b.v)) AS diversity FROM t a JOIN t b ON a.user_id = b.user_id AND a.item <> b.item GROUP BY 1)",
    then="SELECT user_id, count(DISTINCT category) AS distinct_categories, count(DISTINCT item % 20) AS distinct_channels, any_value(category_mix) AS category_mix, round(median(age_days), 1) AS median_age_days, round(avg(-log2(greatest(coalesce(p, 0), 1) / (SELECT sum(p) FROM pop))), 2) AS novelty_bits, round(coalesce(any_value(diversity), 0), 4) AS diversity FROM t JOIN mx USING (user_id) LEFT JOIN dv USING (user_id) GROUP BY 1"))
def page_diagnostics(spark, d):
    """What each page is made of: categories and their mix, channels, median age, novelty, diversity."""
    c = written(candidates(spark, d), "candidates")
    f = recall.fuse(c, "user_id", most=10).join(vectors(spark, d).select("item", "category", "v"), "item").join(stats(spark, d).select(F.col("video_id").alias("item"), "age_days"), "item")
    pop = recall.sessions(event_impressions(spark, d)).groupBy("item").agg(F.count(F.lit(1)).alias("p"))
    f = f.join(pop, "item", "left").crossJoin(F.broadcast(pop.agg(F.sum("p").alias("t"))))
    mix = f.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "category"))), lambda x: F.concat(x["category"], F.lit(":"), (-x["less"]).cast("string"))), ", ").alias("category_mix"))
    apart = pairwise_mean_cosine(f.select("user_id", "item", "v"), ["user_id"]).select("user_id", F.when(F.col("n") < 2, 0.0).otherwise(1 - F.col("coherence")).alias("diversity"))
    bits = -F.log2(F.greatest(F.coalesce("p", F.lit(0)), F.lit(1)) / F.col("t"))
    per = f.groupBy("user_id").agg(F.countDistinct("category").alias("distinct_categories"), F.countDistinct(F.col("item") % 20).alias("distinct_channels"), F.round(F.median("age_days"), 1).alias("median_age_days"), F.round(F.avg(bits), 2).alias("novelty_bits"))
    return per.join(mix, "user_id").join(apart.select("user_id", F.round("diversity", 4).alias("diversity")), "user_id")


POOL, SAMPLE = 600, 24


@query(with_sql(CAT, "pl AS (SELECT *, row_number() OVER (ORDER BY view_count DESC, video_id) AS n FROM cat)", then="SELECT video_id, title, channel_id, category, view_count FROM pl WHERE n <= 600 ORDER BY (video_id * 2654435761 + 29) % 1000003, video_id LIMIT 24"))
def browse_sample(spark, d):
    """Some of the most viewed items to start from, drawn by hash without replacement."""
    pool = catalog(spark, d).orderBy(F.desc("view_count"), "video_id").limit(POOL)
    return pool.orderBy(ix.hash_order(F.col("video_id"), 29), "video_id").limit(SAMPLE).select("video_id", "title", "channel_id", "category", "view_count")


@query(with_sql(EV, then="SELECT event_id, round(1 / (1 + exp(-(-1.2 + 2.0 * watch_fraction - 0.15 * rank_shown))), 6) AS p_click, round(least(greatest(0.35 + 0.4 * tanh(watch_fraction) - 0.05 * rank_shown, 0.01), 1.0), 6) AS watch_mean FROM ev"))
def click_model(spark, d):
    w, r = F.col("watch_fraction"), F.col("rank_shown")
    p = 1 / (1 + F.exp(-(-1.2 + 2.0 * w - 0.15 * r)))
    return event_impressions(spark, d).select("event_id", F.round(p, 6).alias("p_click"), F.round(F.least(F.greatest(0.35 + 0.4 * F.tanh(w) - 0.05 * r, F.lit(0.01)), F.lit(1.0)), 6).alias("watch_mean"))
