"""Readers and sinks of catalogs and logs: Parquet, CSV with aliases, JSON side files, JSON-lines caches, ratings."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.catalog import coerce, resolve_aliases

#: Names that a catalog's columns go by.
ALIASES = {
    "video_id": ["video_id", "id"], "title": ["title"], "channel_id": ["channel_id"], "channel_title": ["channel_title", "channelTitle"], "category": ["category", "category_name"], "category_id": ["category_id", "categoryId"],
    "tags": ["tags"], "description": ["description"], "published_at": ["published_at", "publish_time", "publishedAt"], "view_count": ["view_count", "views"], "like_count": ["like_count", "likes"], "comment_count": ["comment_count", "comments"],
}


def encodings(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """UTF-8 for the files that are valid UTF-8 throughout, ISO-8859-1 for the others; one pass over all files, line by line, which is not decoded."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("file"), F.call_function("is_valid_utf8", F.col("value")).alias("ok"))
    bad = {unquote(r.file).split(":", 1)[-1].lstrip("/") for r in lines.groupBy("file").agg(F.bool_and("ok").alias("ok")).filter("not ok").collect()}
    return {p: "ISO-8859-1" if unquote(p).split(":", 1)[-1].lstrip("/") in bad else "UTF-8" for p in paths}


def read_csv(spark: SparkSession, paths: list[str], encoding: str | None = None) -> DataFrame:
    """CSV files of different headers, each with its aliases resolved, one under the other. Without an ``encoding`` each file is read in its own, as ``encodings`` tells it."""
    own = dict.fromkeys(paths, encoding) if encoding else encodings(spark, paths)
    out = None
    for p in paths:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", own[p]).csv(p)
        df = resolve_aliases(df, ALIASES)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def category_names(spark: SparkSession, path: str) -> DataFrame:
    """(category_id, name) from a JSON side file {"items": [{"id", "snippet": {"title"}}]}."""
    schema = "items array<struct<id: string, snippet: struct<title: string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("items").alias("i")).select(F.col("i.id").alias("category_id"), F.col("i.snippet.title").alias("name"))


def catalog_from_csv(spark: SparkSession, paths: list[str], names: DataFrame | None = None) -> DataFrame:
    """A coerced catalog: aliases resolved, categories named (unknown ones Entertainment), of each id the row of most views."""
    df = read_csv(spark, paths)
    if names is not None and "category_id" in df.columns:
        df = df.join(F.broadcast(names), "category_id", "left").withColumn("category", F.coalesce("name", F.lit("Entertainment"))).drop("name")
    df = coerce(df, {**{c: ("string", "") for c in ("video_id", "title", "channel_id", "channel_title", "category", "tags", "description")}, **{c: ("bigint", 0) for c in ("view_count", "like_count", "comment_count")}})
    peak = Window.partitionBy("video_id").orderBy(F.desc("view_count"), "title")
    return df.withColumn("__n", F.row_number().over(peak)).filter((F.col("__n") == 1) & (F.col("video_id") != "")).drop("__n")


def read_cache(spark: SparkSession, path: str, schema: T.StructType, key: str, at: str) -> DataFrame:
    """A JSON-lines cache: of each key the row written last."""
    last = Window.partitionBy(key).orderBy(F.desc(at))
    return spark.read.schema(schema).json(path).withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def append_cache(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_ratings(spark: SparkSession, path: str, positive: float = 4.0) -> DataFrame:
    """Tab-separated user, item, rating, ts as impressions of which ratings of ``positive`` or more are clicks."""
    df = spark.read.option("sep", "\t").schema("user_id long, item long, rating double, ts long").csv(path)
    return df.withColumns({"clicked": (F.col("rating") >= positive).cast("int"), "watch_fraction": F.col("rating") / 5.0, "session_id": F.col("user_id").cast("string"), "rank_shown": F.lit(0)})


def first_that_works(sources: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame, list[str]]:
    """The first source that can be read and has rows, and a note about each one tried."""
    notes = []
    for name, read in sources:
        try:
            df = read()
            if not df.isEmpty():
                return df, [*notes, f"{name}: used"]
            notes.append(f"{name}: empty")
        except (AnalysisException, FileNotFoundError, PermissionError) as e:  # the source is not there; any other error is one
            notes.append(f"{name}: {type(e).__name__}")
    raise ValueError(f"no source has rows: {notes}")


def missing_keys(artifact: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Keys of an artifact that the catalog lacks and the other way round; empty if they fit."""
    a, c = artifact.select(key).distinct(), catalog.select(key).distinct()
    return a.join(c, key, "left_anti").withColumn("side", F.lit("artifact")).unionByName(c.join(a, key, "left_anti").withColumn("side", F.lit("catalog")))


def require_fit(artifact: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """``artifact`` if it has exactly the catalog's keys, else an error that names how many are missing on each side."""
    wrong = {r.side: r["count"] for r in missing_keys(artifact, catalog, key).groupBy("side").count().collect()}
    if wrong:
        raise ValueError(f"keys do not fit, rows by side: {wrong}")
    return artifact


def with_truth(items: DataFrame, truth: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``items`` with columns of ground truth, which the serving catalog does not have. Never a default: a column that ``truth`` lacks, an item without a row or a null value is an error."""
    lacking = [c for c in columns if c not in truth.columns]
    if lacking:
        raise ValueError(f"ground truth lacks the columns {lacking}")
    known = truth.select(key, *columns)
    whole = known.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    lost = items.select(key).join(whole, key, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} items have no ground truth in {columns}")
    return items.join(known, key)
