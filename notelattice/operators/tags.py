"""Tag listing and tag search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_tags(pages: DataFrame) -> DataFrame:
    """Distinct tags in binary order."""
    return pages.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def search_tags(pages: DataFrame, tags: list[str], tag_match: str = "or") -> DataFrame:
    """Pages with any (``or``) or all (``and``) of ``tags``, by title; ties by slug."""
    if tag_match not in ("or", "and"):
        raise ValueError("tag_match must be 'or' or 'and'")
    hits = pages.select("slug", "title", "tags", "page_type")
    if not tags:
        return hits.limit(0)
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(tags)])
    if tag_match == "or":
        match = F.arrays_overlap("tags", wanted)
    else:
        match = F.size(F.array_except(wanted, F.col("tags"))) == 0
    return hits.where(match).orderBy("title", "slug")
