"""Data-quality report: ``issues(severity, scope, message)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.functions.text import is_blank, slug_error
from notelattice.operators.lookup import orphans
from notelattice.operators.skew import salted_join

SCOPES = ("lint", "orphans", "backlinks", "full")


def _issue(severity: str, scope: str, message: Column) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(scope).alias("scope"), message.alias("message")
    )


def lint(pages: DataFrame) -> DataFrame:
    """All page checks in one pass."""
    checks = [
        (is_blank(F.col("title")), "error", "' has empty title"),
        (is_blank(F.col("compiled_truth")), "warning", "' has empty compiled_truth"),
        (slug_error(F.col("slug")).isNotNull(), "error", "' has invalid slug format"),
        ((F.col("page_type") == "Source") & (F.size("sources") == 0), "warning", "' (Source) has empty sources"),
        (F.size("tags") == 0, "warning", "' has empty tags"),
        (F.size("timeline") == 0, "warning", "' has empty timeline"),
    ]
    found = [
        F.when(bad, _issue(severity, "lint", F.concat(F.lit("Page '"), F.col("slug"), F.lit(text))))
        for bad, severity, text in checks
    ]
    return pages.select(F.explode(F.array_compact(F.array(*found))).alias("issue")).select("issue.*")


def orphan_issues(pages: DataFrame, links: DataFrame) -> DataFrame:
    message = F.concat(F.lit("Page '"), F.col("slug"), F.lit("' has no inbound links"))
    return orphans(pages, links).select(_issue("warning", "orphans", message).alias("issue")).select("issue.*")


def broken_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose target page is missing, one row per link row; a popular target is spread over tasks."""
    edges = links.select("source_slug", F.col("target_slug").alias("slug"), "link_type")
    return salted_join(edges, pages.select("slug"), "slug", "left_anti").select(
        "source_slug", F.col("slug").alias("target_slug"), "link_type"
    )


def broken_link_issues(pages: DataFrame, links: DataFrame) -> DataFrame:
    message = F.concat(
        F.lit("Page '"),
        F.col("source_slug"),
        F.lit("' links to nonexistent page '"),
        F.col("target_slug"),
        F.lit("'"),
    )
    return broken_links(pages, links).select(_issue("error", "backlinks", message).alias("issue")).select("issue.*")


def maintain(pages: DataFrame, links: DataFrame, scope: str = "full") -> DataFrame:
    """The report for one scope; ``full`` is the union of all."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
    parts = []
    if scope in ("lint", "full"):
        parts.append(lint(pages))
    if scope in ("orphans", "full"):
        parts.append(orphan_issues(pages, links))
    if scope in ("backlinks", "full"):
        parts.append(broken_link_issues(pages, links))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def issue_counts(report: DataFrame) -> DataFrame:
    """``(scope, severity, issues_count)`` of a report of ``maintain``."""
    return report.groupBy("scope", "severity").agg(F.count("*").alias("issues_count"))
