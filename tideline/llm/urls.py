"""URL filters by a tree of path templates per host.

Addresses are cut into host and path. Segments of a path that look like numbers or hexadecimal keys become shapes. Down each host's tree, level by level,

1. rare children are generalised: a child with fewer than ``min_child`` addresses becomes a wildcard;
2. similar branches merge: siblings whose distribution over the next level's shapes cannot be told from that of all siblings by a chi-square bound become one
   wildcard branch, whether they have labels or not, and their labels are pooled. A labelled child whose share of bad labels is over two standard deviations off its
   branch's keeps its own name;
3. what results are templates. A template is rejected if its share of bad labels, smoothed by ``alpha`` addresses of share ``prior``, reaches ``purity``. One without labels is
   judged by its nearest labelled ancestor on the host, else by the same template over all hosts.

The tree is as deep as its paths, save that a branch of fewer than ``min_branch`` addresses ends in one rest. Statistics are sums over distinct (host, shapes), so a hot host is
summed before it moves. Explicit rules (host suffix and path prefix, the longest wins) come before templates, and the addresses that rules decide are the labels
from which the templates of other addresses are judged, unless a label column is given.

Null addresses and such without ``://`` have empty host and path; they form the root template of the empty host. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, written


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. ``rules``: (verdict, ``host/path``)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.substring_index(segment, ".", -1)))
        .when(segment.rlike(r"^[0-9a-fA-F\-]{8,}$"), F.lit("{h}"))
        .otherwise(segment)
    )


def shapes_of(path: Column) -> Column:
    """Shapes of all segments."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


#: The token of a merged branch, and of what follows in a branch of too few addresses.
ANY, REST = "*", "**"
SUMS = ("n", "labelled", "bad")


def _tokens(pairs: DataFrame, min_child: int, salts: int) -> DataFrame:
    """(host, template, child, token) for the children of each node; ``pairs``: (host, template, child, following) with their sums."""
    key = ["host", "template"]
    kids = pairs.groupBy(*key, "child").agg(*[F.sum(c).alias(f"{c}_child") for c in SUMS])
    pool = pairs.groupBy(*key, "following").agg(F.sum("n").alias("n_pool"))
    total = pool.groupBy(*key).agg(F.sum("n_pool").alias("n_total"), F.count(F.lit(1)).alias("kinds"))
    siblings = kids.groupBy(*key).agg(F.count(F.lit(1)).alias("siblings"))
    stats = pool.join(total.join(siblings, key), key)
    spread = stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    tested = pairs.withColumn("salt", F.pmod(F.xxhash64("child"), F.lit(salts)).cast("int")).join(spread, [*key, "following", "salt"])
    # sum (o-e)^2/e over all shapes of the pool = sum o^2/e - n_child, for which the shapes that occur suffice; e = n_child * n_pool / n_total
    square = F.sum(F.col("n") * F.col("n") * F.col("n_total") / F.col("n_pool"))
    judged = tested.groupBy(*key, "child").agg(square.alias("square"), F.first("kinds").alias("kinds"), F.first("siblings").alias("siblings")).join(kids, [*key, "child"])
    free = F.col("kinds") - 1
    alike = (F.col("siblings") > 1) & (F.col("square") / F.col("n_child") - F.col("n_child") <= free + 2 * F.sqrt(2 * free) + 1e-9)
    fits = judged.withColumn("fits", ~F.col("child").startswith("{") & (alike | (F.col("n_child") < min_child)))
    merged = fits.filter("fits").groupBy(*key).agg(F.sum("labelled_child").alias("l"), F.sum("bad_child").alias("b"))
    both = fits.join(merged, key, "left")
    share = F.when(F.col("l") > 0, F.col("b") / F.col("l"))
    off = F.col("bad_child") - F.col("labelled_child") * share
    contrary = (F.col("labelled_child") > 0) & (off * off > 4 * F.col("labelled_child") * share * (1 - share) + 1e-9)
    return both.select(*key, "child", F.when(F.col("fits") & ~F.coalesce(contrary, F.lit(False)), ANY).otherwise(F.col("child")).alias("token"))


def _contracted(going: DataFrame, min_branch: int) -> tuple[DataFrame, DataFrame]:
    """(done, going): what every path of a branch has in common is added to its template at once, as steps of a single child each would.

    Where all paths of a branch are beginnings of the longest, the whole branch is done: it is followed while ``min_branch`` addresses go on, and what is longer ends in one rest.
    """
    at = F.size("template")
    rest = F.slice("shapes", at + 1, F.size("shapes") - at)
    key = ["host", "template"]
    bounds = going.groupBy(*key).agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    same = F.aggregate(F.zip_with("lo", "hi", lambda x, y: x == y), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, ok: F.struct((s["on"] & F.coalesce(ok, F.lit(False))).alias("on"), F.when(s["on"] & F.coalesce(ok, F.lit(False)), s["n"] + 1).otherwise(s["n"]).alias("n")), lambda s: s["n"])
    joined = going.join(bounds.withColumn("same", same), key).withColumns({"own": F.size(rest), "begins": (F.slice("hi", 1, F.size(rest)) == rest).cast("int")})
    by = joined.groupBy(*key, "own").agg(F.sum("n").alias("here"), F.min("begins").alias("begins"))
    longer = Window.partitionBy(*key).orderBy(F.desc("own")).rowsBetween(Window.unboundedPreceding, 0)
    # the first length at which fewer than min_branch addresses go on
    reach = by.withColumn("from_here", F.sum("here").over(longer)).groupBy(*key).agg(F.min("begins").alias("chain"), F.coalesce(F.max(F.when(F.col("from_here") >= min_branch, F.col("own"))), F.lit(0)).alias("reach"))
    whole = written(joined.drop("begins").join(reach, key), "contracted")
    columns = ["host", "shapes", "n", "labelled", "bad"]
    chain = F.col("chain") == 1
    cut = F.when(F.col("own") <= F.col("reach"), F.col("shapes")).otherwise(F.concat(F.slice("shapes", 1, at + F.col("reach")), F.array(F.lit(REST))))
    followed = F.concat("template", F.slice("hi", 1, F.col("same")))
    tokens = F.when(F.size("template") == 0, cut).otherwise(F.concat("template", F.slice(cut, at + 1, F.size(cut) - at)))
    return whole.filter(chain).select(*columns, tokens.alias("template")), whole.filter(~chain).select(*columns, followed.alias("template"))


def templates(addresses: DataFrame, min_child: int = 3, min_branch: int = 8, salts: int = 16) -> DataFrame:
    """(host, shapes, n, labelled, bad, template) for each different (host, shapes); ``template`` is an array of tokens.

    ``addresses``: host, shapes and bad (1 bad, 0 good, null unknown). Levels are added until every path has ended or is in a branch of fewer than ``min_branch`` addresses; a stretch that a branch
    has in common is one step, so steps follow where paths part and not how deep they are.
    """
    nodes = addresses.groupBy("host", "shapes").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    going, done = written(nodes.withColumn("template", F.array().cast("array<string>")), "nodes"), []
    key = ["host", "template"]
    while True:
        level = F.size("template")
        done.append(going.filter(F.size("shapes") <= level))
        on = going.filter(F.size("shapes") > level)
        if on.isEmpty():
            return reduce(DataFrame.unionByName, done)
        sizes = on.groupBy(*key).agg(F.sum("n").alias("n_branch"))
        here = on.join(sizes, key)
        few = F.col("n_branch") < min_branch
        columns = [c for c in going.columns if c != "template"]
        ended = written(here.filter(few).select(*columns, F.concat("template", F.array(F.lit(REST))).alias("template")), "ended")
        followed, parting = _contracted(here.filter(~few).drop("n_branch"), min_branch)
        done += [ended, followed]
        # a stretch in common may have brought some to their ends and left too few; they are seen to in the next round
        stopped = parting.filter(F.size("shapes") <= F.size("template"))
        large = parting.filter(F.size("shapes") > F.size("template"))
        left = large.join(large.groupBy(*key).agg(F.sum("n").alias("n_branch")), key)
        small = left.filter(F.col("n_branch") < min_branch).drop("n_branch")
        large = written(left.filter(F.col("n_branch") >= min_branch).drop("n_branch").withColumns({"child": F.get("shapes", F.size("template")), "following": F.coalesce(F.get("shapes", F.size("template") + 1), F.lit("{end}"))}), "here")
        pairs = large.groupBy(*key, "child", "following").agg(*[F.sum(c).alias(c) for c in SUMS])
        tokens = _tokens(written(pairs, "pairs"), min_child, salts)
        stepped = large.join(tokens, [*key, "child"]).select(*columns, F.concat("template", F.array("token")).alias("template"))
        going = written(stepped.unionByName(stopped.select(*columns, "template")).unionByName(small.select(*columns, "template")), "nodes")


def shares(nodes: DataFrame, alpha: float, prior: float) -> DataFrame:
    """(host, template, template_share): the smoothed share of bad labels. A template without labels takes the share of its nearest ancestor on the host that has any,
    else that of the same template, or its nearest ancestor, over all hosts, else ``prior``."""
    own = nodes.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    # a beginning of a template is told by its length and a hash of its tokens, so that deep templates are not copied once a level
    chained = F.aggregate("template", F.array(F.lit(0).cast("long")), lambda done, token: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), token))))
    prefixes = F.transform(chained, lambda h, i: F.struct(i.alias("depth"), h.alias("h")))
    each = written(own.select("host", "template", "l", "b", F.explode(prefixes).alias("prefix")), "prefixes")
    smooth = (F.sum("b") + alpha * prior) / (F.sum("l") + alpha)
    of_host = each.filter("l > 0").groupBy("host", "prefix").agg(smooth.alias("host_share"))
    of_all = each.filter("l > 0").groupBy("prefix").agg(smooth.alias("all_share"))
    depth = F.col("prefix.depth")
    found = each.join(of_host, ["host", "prefix"], "left").join(of_all, "prefix", "left")
    best = found.groupBy("host", "template").agg(F.max_by("host_share", F.when(F.col("host_share").isNotNull(), depth)).alias("h"), F.max_by("all_share", F.when(F.col("all_share").isNotNull(), depth)).alias("a"))
    return best.select("host", "template", F.coalesce("h", "a", F.lit(prior)).alias("template_share"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", key: str = "page_id", label: str | None = None, min_child: int = 3, min_branch: int = 8, alpha: float = 2.0, prior: float = 0.1, purity: float = 0.5, salts: int = 16) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict, template, template_share. Other columns of ``pages`` are left out, so none can clash.

    The join that brings a template back to addresses is on (host, shapes), which may be hot: the adaptive plan splits it.
    """
    base = pages.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), *([F.col(label).alias("__label")] if label else []))
    base = base.withColumns({"__rule": rule_for(F.col("host"), F.col("path"), rules), "shapes": shapes_of(F.col("path"))})
    bad = F.col("__label").cast("int") if label else (F.col("__rule.verdict") == "block").cast("int")
    nodes = written(templates(base.select("host", "shapes", bad.alias("bad")), min_child, min_branch, salts), "nodes")
    of = nodes.select("host", "shapes", "template").join(shares(nodes, alpha, prior), ["host", "template"])
    learned = F.when(F.col("template_share") >= purity, "block").otherwise("allow")
    name = F.concat(F.lit("/"), F.array_join("template", "/")).alias("template")
    return base.join(of, ["host", "shapes"]).select(key, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), learned).alias("verdict"), name, "template_share")
