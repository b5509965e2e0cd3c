"""Lookups, listings and collection statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelattice.functions.text import content_hash, is_hidden, is_raw_path, normalize_slug
from notelattice.operators.parse import parse_notes
from notelattice.schema import FRONTMATTER_KEYS, TIMELINE_ENTRY


def get_page(pages: DataFrame, slug: str) -> DataFrame:
    return pages.where(F.col("slug") == slug)


def get_pages(pages: DataFrame, slugs: DataFrame) -> DataFrame:
    """Batch lookup by ``slugs(slug)``."""
    return pages.join(slugs.select("slug").distinct(), "slug", "left_semi")


def page_view(notes: DataFrame) -> DataFrame:
    """What reading each of ``notes(path, raw_content)`` shows; raw notes have no frontmatter or timeline.

    A note that cannot be parsed has a row with its ``error`` and nothing else.
    """
    notes = notes.withColumn("slug", normalize_slug(F.col("path")))
    frontmatter = F.struct(*FRONTMATTER_KEYS)
    fine = F.col("parse_error").isNull()
    wiki = parse_notes(notes.where(~is_raw_path(F.col("slug")))).withColumn("frontmatter", frontmatter).select(
        "slug",
        F.when(fine, F.col("frontmatter")).alias("frontmatter"),
        F.when(fine, F.col("compiled_truth")).alias("body"),
        F.when(fine, F.col("timeline")).alias("timeline"),
        F.when(fine, F.col("content_hash")).alias("content_hash"),
        F.col("parse_error").alias("error"),
    )
    raw = notes.where(is_raw_path(F.col("slug"))).select(
        "slug",
        F.col("raw_content").alias("body"),
        F.array().cast(f"array<{TIMELINE_ENTRY.simpleString()}>").alias("timeline"),
        content_hash(F.col("raw_content")).alias("content_hash"),
    )
    return wiki.unionByName(raw, allowMissingColumns=True)


def list_slugs(pages: DataFrame) -> DataFrame:
    return pages.select("slug")


def list_dir(notes: DataFrame, directory: str = ".") -> DataFrame:
    """Direct child files and folders ``(path, kind)`` of a folder, hidden ones left out."""
    prefix = "" if directory in (".", "") else directory.rstrip("/") + "/"
    below = notes.where(F.col("path").startswith(prefix)) if prefix else notes
    rest = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    kind = F.when(rest.contains("/"), F.lit("folder")).otherwise(F.lit("file"))
    child = F.concat(F.lit(prefix), F.substring_index(rest, "/", 1))
    return below.select(child.alias("path"), kind.alias("kind")).distinct().where(~is_hidden(F.col("path")))


def has_link(links: DataFrame, source: str, target: str) -> DataFrame:
    """One row: is there a direct link?"""
    found = links.where((F.col("source_slug") == source) & (F.col("target_slug") == target))
    return found.agg((F.count("*") > 0).alias("has_link"))


def has_link_batch(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(source_slug, target_slug)`` with ``has_link``; equal links combine before the join."""
    edges = links.select("source_slug", "target_slug").distinct().withColumn("_found", F.lit(True))
    return (
        pairs.join(edges, ["source_slug", "target_slug"], "left")
        .withColumn("has_link", F.coalesce("_found", F.lit(False)))
        .drop("_found")
    )


def count_rows(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def pages_by_type(pages: DataFrame) -> DataFrame:
    return pages.groupBy("page_type").agg(F.count("*").alias("n_pages"))


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages with no inbound link. Targets combine before the join, so a popular target is one row."""
    targets = links.select(F.col("target_slug").alias("slug")).distinct()
    return pages.select("slug").join(targets, "slug", "left_anti")


def collection_stats(pages: DataFrame, links: DataFrame) -> DataFrame:
    """One row: page count, page count by type, link count, orphan count."""
    by_type = pages_by_type(pages)
    n_links = count_rows(links, "n").scalar()
    n_orphans = count_rows(orphans(pages, links), "n").scalar()
    return by_type.agg(
        F.coalesce(F.sum("n_pages"), F.lit(0)).cast("long").alias("total_pages"),
        # One entry per page type, of which there are six.
        F.map_from_entries(F.collect_list(F.struct("page_type", "n_pages"))).alias("pages_by_type"),
    ).select("total_pages", "pages_by_type", n_links.alias("total_links"), n_orphans.alias("orphan_count"))


def listing_counts(notes: DataFrame, directory: str = ".") -> DataFrame:
    """``(kind, n_children)`` of a folder's direct children."""
    return list_dir(notes, directory).groupBy("kind").agg(F.count("*").alias("n_children"))


def json_rows(result: DataFrame) -> DataFrame:
    """Any result as one JSON text per row, ``value``; nulls are written."""
    return result.select(F.to_json(F.struct(*result.columns), {"ignoreNullFields": "false"}).alias("value"))
