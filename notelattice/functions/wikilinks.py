"""Wikilinks ``[[type::target|display]]`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelattice.functions.text import normalize_slug, text_from, trim_ws

# Text up to the next backtick or bracket, then a fenced block, an inline code span, a link whose inner text is
# group 1, or that one character. Possessive, so that long texts need no deep regex stack.
WIKILINK = (
    r"(?s)[^`\[]*+(?:(?<![^\n])`{3,}[^\n]*(?:.*?\n`{3,}[^\n]*|.*\z)"
    r"|`[^`]*(?:`|\z)"
    r"|\[\[((?:[^\[\]]++|\[(?!\[)|\](?!\]))*+)\]\]"
    r"|.|\z)"
)


def link_bodies(text: Column) -> Column:
    """Inner texts of all links outside code, in order."""
    found = F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1))
    return F.when(text.contains("[["), F.filter(found, lambda x: x != "")).otherwise(
        F.array().cast("array<string>")
    )


def parse_links(inner: Column) -> Column:
    """Structs (target_slug, link_type, context_snippet) of inner texts; a null target marks a malformed link.

    Step by step, because what a function of an array refers to twice is computed twice.
    """

    def halves(text: Column) -> Column:
        bar = F.instr(text, "|")
        return F.struct(
            F.when(bar > 0, F.substring(text, F.lit(1), bar - 1)).otherwise(text).alias("body"),
            F.when(bar > 0, text_from(text, bar + 1)).alias("display"),
        )

    def trimmed(link: Column) -> Column:
        return F.struct(trim_ws(link["body"]).alias("body"), trim_ws(link["display"]).alias("display"))

    def parts(link: Column) -> Column:
        body = link["body"]
        colons = F.instr(body, "::")
        return F.struct(
            F.when(colons > 0, trim_ws(F.substring(body, F.lit(1), colons - 1))).otherwise(F.lit("plain")).alias("kind"),
            F.when(colons > 0, trim_ws(text_from(body, colons + 2))).otherwise(body).alias("target"),
            link["display"].alias("display"),
        )

    def parsed(link: Column) -> Column:
        kind, target, display = link["kind"], link["target"], link["display"]
        return F.struct(
            F.when((target != "") & (kind != ""), normalize_slug(target)).alias("target_slug"),
            kind.alias("link_type"),
            F.when(display != "", display).alias("context_snippet"),
        )

    for step in (trim_ws, halves, trimmed, parts, parsed):
        inner = F.transform(inner, step)
    return inner


def extract_links(text: Column) -> Column:
    """Array of parsed links of a text, in order; code spans and malformed links left out."""
    return F.filter(parse_links(link_bodies(text)), lambda x: x["target_slug"].isNotNull())
