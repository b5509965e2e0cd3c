"""Nearest pages to one given embedding vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, vec_id: int, k: int = 10) -> DataFrame:
    """``(vec_id, similarity)`` of the ``k`` vectors closest by cosine to the stored vector ``vec_id``.

    One scan with a per-task top-k: the given vector is a scalar subquery, so nothing is paired or shuffled.
    """
    given = vectors.where(F.col("vec_id") == vec_id).agg(F.first("embedding")).scalar()
    compared = vectors.where(F.col("vec_id") != vec_id).withColumn("_given", given)
    norms = F.sqrt(_dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(_dot(F.col("_given"), F.col("_given")))
    similarity = _dot(F.col("embedding"), F.col("_given")) / norms
    return compared.select("vec_id", similarity.alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)
