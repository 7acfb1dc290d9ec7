"""Catalog cleaning, derived item statistics and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000.0


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """For each wanted column the first alias that ``df`` has; wanted columns without one are left out."""
    found = {want: next((a for a in names if a in df.columns), None) for want, names in aliases.items()}
    return df.select(*[F.col(a).alias(want) for want, a in found.items() if a])


def coerce(df: DataFrame, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns of ``schema`` (type, default) only: missing ones added, values cast, what cannot be cast or is null set to the default."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(df[c].try_cast(kind), F.lit(default).cast(kind)) if c in have else F.lit(default).cast(kind)).alias(c) for c, (kind, default) in schema.items()])


def clean_catalog(df: DataFrame, item: str, title: str, *order: str) -> DataFrame:
    """Without empty ids, the first row of each id, without blank titles."""
    first = Window.partitionBy(item).orderBy(*order)
    ok = df.filter(F.col(item).isNotNull() & (F.col(item).cast("string") != ""))
    return ok.withColumn("__n", F.row_number().over(first)).filter((F.col("__n") == 1) & (F.length(F.trim(F.col(title))) > 0)).drop("__n")


def share(a: Column, b: Column) -> Column:
    """a / b kept within 0 and 1; 0 where b is 0."""
    return F.coalesce(F.least(F.greatest(F.try_divide(a, b), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def age_days(published: Column, now: Column) -> Column:
    return F.coalesce(F.greatest((now - published) / DAY_US, F.lit(0.0)), F.lit(365.0))


def item_stats(items: DataFrame, now: Column) -> DataFrame:
    """The derived numeric columns of a catalog."""
    views = F.col("view_count").cast("double")
    df = items.withColumns({
        "age_days": age_days(F.col("published"), now),
        "log_views": F.log1p(F.greatest(views, F.lit(0.0))),
        "like_rate": share(F.col("like_count").cast("double"), views),
        "comment_rate": share(F.col("comment_count").cast("double"), views),
        "duration_minutes": F.col("duration_seconds") / 60.0,
        "is_short": (F.col("duration_seconds") <= 75).cast("int"),
        "title_length": F.length("title"),
    })
    per_day = views / F.greatest(F.col("age_days"), F.lit(1.0))
    return df.withColumns({
        "engagement_rate": F.least(F.greatest(F.col("like_rate") + 5 * F.col("comment_rate"), F.lit(0.0)), F.lit(1.0)),
        "views_per_day": per_day,
        "log_views_per_day": F.log1p(per_day),
    })


def split_tags(tags: Column, by: str = r"\|") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), by), lambda t: F.trim(t)), lambda t: (t != "") & (t != "nan"))


def iso_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 duration of days, hours, minutes and seconds; 0 if it is not one."""
    form = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    part = lambda i: F.coalesce(F.regexp_extract(text, form, i).try_cast("bigint"), F.lit(0))
    return F.coalesce(part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4), F.lit(0))


def freshness(age: Column, weight: float = 0.08, half_life: float = 21.0) -> Column:
    return 1 + weight * F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life)


def short_title(title: Column, most: int = 42) -> Column:
    return F.when(F.length(title) <= most, title).otherwise(F.concat(F.rtrim(F.substring(title, 1, most - 1)), F.lit("…")))


def surrogate_id(name: Column) -> Column:
    return F.concat(F.lit("UC"), F.substring(F.md5(name), 1, 20))


def zscore(df: DataFrame, col: str, out: str) -> DataFrame:
    """Over the whole table, by the population's deviation; 0 where that is 0. Two sums are broadcast, no row moves."""
    stats = df.agg(F.avg(col).alias("__m"), F.stddev_pop(col).alias("__s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(out, F.when(F.col("__s") > 0, (F.col(col) - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")


def trending_score(half_life: float = 21.0) -> Column:
    return F.col("log_views_per_day") * F.pow(F.lit(0.5), F.col("age_days") / half_life) * (1 + 2 * F.col("engagement_rate"))


def popular_score() -> Column:
    return F.col("log_views") * (1 + 1.5 * F.col("engagement_rate"))
