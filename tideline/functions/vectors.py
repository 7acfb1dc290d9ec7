"""Vectors as array columns of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, floor: float = 1e-9) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-9)) * F.greatest(norm(b), F.lit(1e-9)))


def blend(a: Column, b: Column, share: Column) -> Column:
    """share of a, the rest of b, at unit length."""
    return l2(F.zip_with(a, b, lambda x, y: share * x + (1 - share) * y))


def weighted_sum(df: DataFrame, keys: list[str], vector: str, weight: Column, out: str = "v") -> DataFrame:
    """Weighted sum of vectors by group, summed component by component so that no group is gathered."""
    parts = df.select(*keys, F.posexplode(vector).alias("__p", "__x"), weight.alias("__w"))
    sums = parts.groupBy(*keys, "__p").agg(F.sum(F.col("__x") * F.col("__w")).alias("__s"))
    return sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__p", "__s"))), lambda s: s["__s"]).alias(out))
