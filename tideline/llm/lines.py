"""Line dedup over levelled sorted runs of line hashes.

A run is a Parquet table (h, n): the hash of a line's key and the number of documents that have it, sorted by h.
``LineRuns.add`` takes a batch: it counts the batch's keys, drops by a merge-anti-join those that the saturated run
already holds (their fate is settled), and writes the others as a run of level 0. When a level has ``fanout`` runs they are
merged into one of the next level; a merge moves the keys that have reached ``min_docs`` to the saturated run.
``LineRuns.frequent`` sums what is left. Every run is a plain table in the shared folder, so a lost executor loses nothing.

A key is the line without ASCII white space at both ends and with A-Z lower-cased; keys of fewer than ``min_chars``
code points are never dropped. Hashes are 64-bit (XXH64); where different keys share a frequent hash, which a second one tells, each is counted again on its own. Each row of the input counts as a document of its own, also where rows or ids repeat.
A null or empty text is one empty line. Columns of the input stay as they are, but for ``kept_text``, ``n_lines`` and ``n_dropped``, which are written over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import ascii_lower, fresh_path, spare, text_of, trimmed, written


def line_key(line: Column) -> Column:
    return ascii_lower(trimmed(line))


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _each_key(text: Column, min_chars: int, make: Callable[[Column], Column]) -> Column:
    """``make`` of each line's key; null for keys that are too short."""
    return F.transform(F.transform(F.split(text, "\n", -1), line_key), lambda key: F.when(F.length(key) >= min_chars, make(key)))


def line_hashes(text: Column, min_chars: int = 1) -> Column:
    """For each line its key's hash; null for keys that are too short."""
    return _each_key(text, min_chars, _hash)


class LineRuns:
    """The levelled store of line hashes under one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = path or fresh_path(spark, "line-runs")
        self.levels: list[list[DataFrame]] = []
        self.saturated: list[DataFrame] = []
        self._made = 0

    def _write(self, df: DataFrame) -> DataFrame:
        self._made += 1
        df.write.parquet(at := f"{self.path}/run-{self._made}")
        return self.spark.read.schema(df.schema).parquet(at)

    def _settled(self) -> DataFrame | None:
        out = None
        for run in self.saturated:
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, counts: DataFrame) -> None:
        """Add a batch's (h, n)."""
        if (settled := self._settled()) is not None:
            counts = counts.join(settled.select("h"), "h", "left_anti")
        self._push(self._write(counts.sortWithinPartitions("h")), 0)

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._merged(self.levels[level]), []
            merged = self._write(merged.sortWithinPartitions("h"))
            self.saturated.append(self._write(merged.filter(F.col("n") >= self.min_docs).select("h")))
            self._push(merged.filter(F.col("n") < self.min_docs), level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy("h").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """(h): the keys found in ``min_docs`` documents or more, each once."""
        rest = [r for level in self.levels for r in level]
        late = self._merged(rest).filter(F.col("n") >= self.min_docs).select("h") if rest else self.spark.createDataFrame([], "h long")
        settled = self._settled()
        return self._write(late if settled is None else late.unionByName(settled).distinct())


def batch_counts(docs: DataFrame, text: str = "text", min_chars: int = 1, *keep: Column) -> DataFrame:
    """(…keep, h, n): in how many rows of ``docs`` a key is found."""
    keys = docs.select(*keep, F.explode(F.array_distinct(line_hashes(text_of(docs, text), min_chars))).alias("h")).filter(F.col("h").isNotNull())
    names = [c for c in keys.columns if c != "h"]
    return keys.groupBy(*names, "h").agg(F.count(F.lit(1)).alias("n"))


def _of_frequent_keys(at_hot: DataFrame, min_docs: int) -> DataFrame:
    """The places whose key itself is in ``min_docs`` rows or more. A second hash tells keys of equal hash apart; where there are any, they are counted again, each on its own."""
    shared = at_hot.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("h")
    if shared.isEmpty():
        return at_hot
    counted = at_hot.join(shared, "h", "left_semi").select("row", "h", "g").distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"))
    return at_hot.join(shared, "h", "left_anti").unionByName(at_hot.join(counted.filter(F.col("n") >= min_docs), ["h", "g"], "left_semi"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, batches: int = 3, broadcast_rows: int = 200_000) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``.

    The batches' counts come from one pass over the texts and enter the runs one after the other. Texts cross the
    network once, to meet the positions of their dropped lines.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs=min_docs)
    batch = F.pmod(F.xxhash64(text_of(docs, text)), F.lit(batches)).cast("int").alias("batch")
    counts = batch_counts(docs, text, min_chars, batch)
    counts.write.partitionBy("batch").parquet(at := fresh_path(spark, "line-batches"))
    counts = spark.read.schema("h long, n long, batch int").parquet(at)
    for b in range(batches):
        runs.add(counts.filter(F.col("batch") == b).select("h", "n"))
    hot = runs.frequent()
    if hot.count() <= broadcast_rows:  # 8 bytes a row
        hot = F.broadcast(hot)
    body = text_of(docs, text)
    places = _each_key(body, min_chars, lambda key: F.struct(_hash(key).alias("h"), F.xxhash64(F.lit("second"), key).alias("g")))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("th"), F.monotonically_increasing_id().alias("row"), F.posexplode(places).alias("pos", "x"))
    at_hot = _of_frequent_keys(written(rows.select("id", "th", "row", "pos", "x.h", "x.g").filter(F.col("h").isNotNull()).join(hot, "h"), "hot-lines"), min_docs)
    id_, th, th2, gone = spare(docs, "id", "th", "th2", "gone")
    dropped = at_hot.groupBy(F.col("id").alias(id_), F.col("th").alias(th)).agg(F.collect_set("pos").alias(gone))
    own = docs.withColumn(th2, F.xxhash64(body))
    lines = F.split(text_of(own, text), "\n", -1)
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    joined = own.join(dropped, own[doc_id].eqNullSafe(dropped[id_]) & (own[th2] == dropped[th]), "left")
    kept = F.array_join(F.transform(F.array_except(every, F.col(gone)), lambda i: F.get(lines, i)), "\n")
    joined = joined.withColumns({
        "kept_text": F.when(F.col(gone).isNull(), text_of(joined, text)).otherwise(kept),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"),
    })
    return joined.drop(id_, th, th2, gone)
