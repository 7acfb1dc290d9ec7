"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, decontaminate, lines, simhash, toxicity
from tideline.llm.common import fresh_path
from tideline.llm.queries import part, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. It is trained on labelled documents outside the held-out fifth."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(part(5) != 0))
    return toxicity.score(docs, model, column="__toxic").filter(F.col("__toxic") < 0.5).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines found in ten documents or more; n_chars follows the text. A null text stays null."""
    out = lines.dedup_lines(docs, min_docs=10, min_chars=1)
    kept = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return out.withColumns({"text": kept, "n_chars": F.when(F.col("n_dropped") > 0, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest doc_id. Alike are texts whose five-word shingles are similar to 0.8 or more."""
    return simhash.keep_one(docs, shingle_words=5, similarity=0.8).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document that is left."""
    return bpe.digests(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A trained model and 64-bit hashes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(at := fresh_path(spark, f"stage-{name}"))
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
