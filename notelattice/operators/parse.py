"""Bulk parsing: notes to pages, links and parse errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.functions import body as B
from notelattice.functions import frontmatter as FM
from notelattice.functions.stage import built_once, staged
from notelattice.functions.text import content_hash, slug_error, trim_long
from notelattice.functions.wikilinks import extract_links
from notelattice.operators.skew import first_per_key
from notelattice.schema import FRONTMATTER_KEYS, LINKS


@built_once
def _split_columns() -> dict[str, Column]:
    yaml, text, error = FM.split_frontmatter(F.col("raw_content"))
    return {"_yaml": yaml, "_body": text, "_split_error": error}


@built_once
def _found_columns() -> dict[str, Column]:
    return FM.found_lines(F.col("_yaml"))


@built_once
def _raw_columns() -> dict[str, Column]:
    return FM.raw_values(F.col("_yaml"))


@built_once
def _read_columns() -> dict[str, Column]:
    return FM.read_values()


@built_once
def _value_columns() -> dict[str, Column]:
    return FM.decode_values()


@built_once
def _chunk_columns() -> dict[str, Column]:
    return {"_decode_error": FM.decode_error(), "_chunks": B.body_chunks(F.col("_body"))}


@built_once
def _separator_columns() -> dict[str, Column]:
    return {"_last": B.last_separator(F.col("_chunks"))}


@built_once
def _body_columns() -> dict[str, Column]:
    truth, section = B.split_body(F.col("_body"), F.col("_chunks"), F.col("_last"))
    return {"_truth": truth, "timeline": B.parse_timeline(section)}


@built_once
def _page_columns() -> dict[str, Column]:
    error = F.coalesce(
        slug_error(F.col("slug")),
        F.concat(
            F.lit("failed to parse frontmatter for page '"),
            F.col("slug"),
            F.lit("': "),
            F.coalesce("_split_error", "_decode_error"),
        ),
    )
    return {
        "compiled_truth": trim_long(F.col("_truth")),
        "timeline_text": B.timeline_text(F.col("timeline")),
        "content_hash": content_hash(F.col("raw_content")),
        "vault": F.lit(""),
        "parse_error": error,
    }


@built_once
def _render_columns() -> dict[str, Column]:
    text = B.render_page(F.col("compiled_truth"), F.col("timeline"), {k: F.col(k) for k in FRONTMATTER_KEYS})
    return {"raw_content": text}


@built_once
def _link_columns() -> dict[str, Column]:
    return {"_links": extract_links(F.col("compiled_truth"))}


def parse_notes(notes: DataFrame) -> DataFrame:
    """``notes(slug, raw_content, ...)`` to page columns plus ``parse_error`` (null for a good page).

    Purely row-wise: no shuffle.
    """
    parsed = notes
    steps = (_split_columns, _found_columns, _raw_columns, _read_columns, _value_columns, _chunk_columns, _separator_columns, _body_columns)
    for columns in steps:
        parsed = staged(parsed, columns())
    scratch = ["_yaml", "_found", "_continued", "_body", "_split_error", "_decode_error", "_chunks", "_truth", "_last", *FM.SCALAR_COLUMNS, *FM.RAW_COLUMNS]
    return parsed.withColumns(_page_columns()).drop(*scratch)


def render_notes(pages: DataFrame) -> DataFrame:
    """Add ``raw_content``, the note text of each page."""
    return pages.withColumns(_render_columns())


def page_links(pages: DataFrame) -> DataFrame:
    """All links of ``pages(slug, compiled_truth)`` with their position; self links dropped."""
    found = staged(pages.select("slug", "compiled_truth"), _link_columns())
    return (
        found.select(F.col("slug").alias("source_slug"), F.posexplode("_links").alias("position", "link"))
        .select("source_slug", "position", "link.*")
        .where(F.col("target_slug") != F.col("source_slug"))
    )


def unique_links(links: DataFrame) -> DataFrame:
    """The first link by position for each (source, target, type)."""
    keys = ["source_slug", "target_slug", "link_type"]
    return first_per_key(links, keys, F.col("position")).select(*LINKS.fieldNames())


def repeated_link_sources(links: DataFrame) -> DataFrame:
    """Pages that hold the same link twice; a strict index refuses the links of such a page."""
    return (
        links.groupBy("source_slug", "target_slug", "link_type")
        .count()
        .where("count > 1")
        .select(F.col("source_slug").alias("slug"))
        .distinct()
    )
