"""Sync from one listing of a folder of note files to the next: deletions and renames are seen, unchanged files not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.functions.text import normalize_slug
from notelattice.operators.skew import if_small
from notelattice.operators.sync import SyncOutcome, remove_pages, sync
from notelattice.session import written
from notelattice.sources.files import changes, list_files, read_files


def sync_files(
    pages: DataFrame, links: DataFrame, root: str, before: DataFrame, as_of: Column, **options
) -> tuple[SyncOutcome, DataFrame, DataFrame, DataFrame]:
    """``(outcome, pages, links, listing)``: both tables brought in step with the files, by a listing of all of them.

    ``before`` is the listing of the last time (an empty one at first), and the one returned is to be kept for the next.
    ``options`` go to ``sync``. All files of a slug that something happened to are read, so that of two paths
    with one slug the other one counts when the first is removed.
    """
    spark = pages.sparkSession
    now = written(list_files(spark, root, options.get("markdown_only", True)), "listed")
    slug = normalize_slug(F.col("path"))
    touched = written(changes(before, now).select(slug.alias("slug")).distinct(), "touched")
    affected = now.withColumn("slug", slug).join(if_small(touched), "slug", "left_semi")
    # Read once: a file that changes meanwhile would be classified as one text and parsed as another.
    notes = written(read_files(spark, root, affected), "contents")
    outcome = sync(pages, links, notes, as_of, removals="none", **options)
    gone = written(touched.join(notes.select(slug.alias("slug")), "slug", "left_anti"), "gone")
    left, left_links = remove_pages(outcome.pages, outcome.links, gone)
    return outcome, left, left_links, now
