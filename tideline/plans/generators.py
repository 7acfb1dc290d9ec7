"""Checks of artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.registry import query
from tideline.sources.adapters import catalog, table
from tideline.sources.files import missing_keys


@query("SELECT 'lineitem' AS artifact, (SELECT count(*) FROM lineitem) AS rows, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) AS unknown")
def artifact_checks(spark, d):
    """Rows of each artifact and how many of its keys do not fit the catalog."""
    c = catalog(spark, d).select(F.col("video_id").alias("item"))
    sold = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"))
    bad = missing_keys(sold, c, "item").filter("side = 'artifact'").agg(F.count(F.lit(1)).alias("unknown"))
    return sold.agg(F.count(F.lit(1)).alias("rows")).crossJoin(bad).withColumn("artifact", F.lit("lineitem"))
