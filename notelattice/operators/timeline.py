"""Timeline analytics over exploded entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timeline_entries(pages: DataFrame) -> DataFrame:
    """One row per entry; ``day`` is null where the date text is no calendar date."""
    return pages.select("slug", F.posexplode("timeline").alias("position", "entry")).select(
        "slug", "position", "entry.*", F.try_to_date("entry.date", "yyyy-MM-dd").alias("day")
    )


def timeline_stats(pages: DataFrame) -> DataFrame:
    """Entry and page counts by date and agent."""
    return (
        timeline_entries(pages)
        .groupBy("date", "agent")
        .agg(F.count("*").alias("n_entries"), F.count_distinct("slug").alias("n_pages"))
    )
