"""Site-relative line frequency: lines that stand on too large a share of a site's pages are boilerplate.

Per page every distinct line counts once. (site, line digest) pairs are counted with a combine before the shuffle,
so a line or a site with a third of all rows costs one partial count per task. A site's boilerplate has at most
(lines per page) / ratio entries, so it fits an array; pages meet the array of their site in one join, which Spark
broadcasts when the stored table is small and otherwise runs as a sort-merge join with split skew. Lines are then
dropped inside the row, where the text never leaves its page.

Defined cases: lines are compared without spaces, tabs and returns at their ends; blank lines are never dropped. A
null text stays null and counts as a page without lines. Pages of a null site belong to no site and stay as they are.
Lines keep their order; a page may become empty but is never removed. Repeated rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.llm.common import restored, slim, stored


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1, min_pages: int = 3
) -> DataFrame:
    """``(host, digest, pages, host_pages)`` of lines on more than ``ratio`` of a site's pages."""
    pages = docs.where(F.col(host_col).isNotNull()).select(
        F.col(host_col).alias("host"),
        F.array_distinct(
            F.transform(F.split(F.col(text_col), "\n", -1), lambda x: line_key(x))
        ).alias("lines"),
    )
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = (
        pages.select("host", F.explode("lines").alias("line"))
        .where("line != ''")
        .select("host", F.md5("line").alias("digest"))
        .groupBy("host", "digest")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return counts.join(totals, "host").where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def drop_boilerplate(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = 0.1, min_pages: int = 3
) -> DataFrame:
    """``docs`` with the boilerplate lines gone from the text, and ``lines_total`` and ``lines_dropped`` added."""
    added = ["lines_total", "lines_dropped"]
    own = slim(docs, {"text": text_col, "host": host_col}, added)
    found = boilerplate(own, "text", "host", ratio, min_pages)
    sites = stored(found.groupBy(F.col("host").alias("_host")).agg(F.collect_list("digest").alias("_bad")), "boilerplate")
    kept = F.filter("_lines", lambda x: ~F.array_contains("_bad", F.md5(line_key(x))))
    kept = F.when(F.col("_bad").isNull(), F.col("_lines")).otherwise(kept)
    joined = own.join(sites, F.col("host") == F.col("_host"), "left")
    cut = joined.withColumn("_lines", F.split("text", "\n", -1)).withColumn("_kept", kept)
    total = F.greatest(F.coalesce(F.size("_lines"), F.lit(0)), F.lit(0))
    left = F.greatest(F.coalesce(F.size("_kept"), F.lit(0)), F.lit(0))
    return cut.select(
        *restored(docs, {text_col: F.array_join("_kept", "\n"), host_col: "host"}, added),
        total.cast("long").alias("lines_total"),
        (total - left).cast("long").alias("lines_dropped"),
    )
