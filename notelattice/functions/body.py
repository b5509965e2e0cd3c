"""Body split, timeline parsing and note rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelattice.functions.frontmatter import render_frontmatter
from notelattice.functions.text import trim_ws
from notelattice.schema import FRONTMATTER_KEYS, TIMELINE_ENTRY, WHITESPACE

WS = r"(?U:\s)*"
FENCE = r"\A(?:`{3,}[^`]*|~{3,}[^~]*)\z"
TIMELINE_LINE = rf"(?s)\A- ([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}){WS}(?:\[([^\]]*)\]{WS})?:(.*)\z"


def last_separator(chunks: Column) -> Column:
    """0-based index of the chunk that begins with the last ``---`` line outside code fences, -1 when there is none.

    Only lines that can matter (a fence or a separator) begin chunks and enter the fold, so a long text without any costs
    one cheap pass.
    """
    first_line = lambda chunk: F.ltrim(F.substring_index(chunk, "\n", 1), F.lit(WHITESPACE))
    marks = F.filter(
        F.transform(chunks, lambda chunk, i: F.struct(i.alias("i"), first_line(chunk).alias("t"))),
        lambda m: m["t"].startswith("---") | m["t"].startswith("```") | m["t"].startswith("~~~"),
    )

    def step(acc: Column, mark: Column) -> Column:
        text, fence = mark["t"], acc["fence"]
        run = F.when(text.rlike(FENCE), F.regexp_extract(text, r"\A(`+|~+)", 1)).otherwise(F.lit(""))
        outside = fence == ""
        closes = (F.left(run, F.lit(1)) == F.left(fence, F.lit(1))) & (F.length(run) >= F.length(fence))
        return F.struct(
            F.when(outside & (run == "") & (trim_ws(text) == "---"), mark["i"])
            .otherwise(acc["last"])
            .alias("last"),
            F.when(outside, run).when(closes, F.lit("")).otherwise(fence).alias("fence"),
        )

    start = F.struct(F.lit(-1).alias("last"), F.lit("").alias("fence"))
    return F.aggregate(marks, start, step)["last"]


def split_body(body: Column, chunks: Column, last: Column) -> tuple[Column, Column]:
    """(truth, not yet trimmed; timeline lines); ``chunks`` and ``last`` come from ``body_chunks`` and ``last_separator``."""
    truth = F.when(last < 0, body).otherwise(F.array_join(F.slice(chunks, F.lit(1), last), "\n"))
    behind = F.split(F.array_join(F.slice(chunks, last + 1, F.greatest(F.size(chunks) - last, F.lit(0))), "\n"), "\n")
    section = F.when(last < 0, F.array().cast("array<string>")).otherwise(F.slice(behind, F.lit(2), F.size(behind)))
    return truth, section


def body_chunks(body: Column) -> Column:
    """The body cut before every line that begins like a fence or a separator, so that its other lines stay together."""
    blank = WHITESPACE.replace("\n", "")
    return F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), rf"\n(?=[{blank}]*+(?:-{{3}}|`{{3}}|~{{3}}))")


def parse_timeline(lines: Column) -> Column:
    """Entries of the lines that have the entry form; all others are skipped."""
    entries = F.filter(
        F.transform(F.filter(lines, lambda x: x.contains("- ")), trim_ws), lambda x: x.rlike(TIMELINE_LINE)
    )

    def entry(line: Column) -> Column:
        bracket = F.when(line.rlike(rf"\A- [0-9-]{{10}}{WS}\["), F.regexp_extract(line, TIMELINE_LINE, 2))
        is_url = bracket.startswith("http://") | bracket.startswith("https://")
        return F.struct(
            F.regexp_extract(line, TIMELINE_LINE, 1).alias("date"),
            F.when(is_url, bracket).alias("source_url"),
            trim_ws(F.regexp_extract(line, TIMELINE_LINE, 3)).alias("content"),
            F.when(~is_url, bracket).alias("agent"),
        )

    return F.transform(entries, entry).cast(f"array<{TIMELINE_ENTRY.simpleString()}>")


def render_timeline_entry(entry: Column) -> Column:
    by = F.coalesce(entry["source_url"], entry["agent"])
    return F.concat(
        F.lit("- "),
        entry["date"],
        F.coalesce(F.concat(F.lit(" ["), by, F.lit("]")), F.lit("")),
        F.lit(": "),
        entry["content"],
    )


def timeline_text(timeline: Column) -> Column:
    """What search sees of a timeline."""
    return F.array_join(F.transform(timeline, lambda e: e["content"]), " ")


def render_page(truth: Column, timeline: Column, frontmatter: dict[str, Column]) -> Column:
    """The note text of a page; the separator is always written."""
    entries = F.transform(timeline, lambda e: F.concat(render_timeline_entry(e), F.lit("\n")))
    return F.concat(render_frontmatter(frontmatter), truth, F.lit("\n\n---\n"), F.array_join(entries, ""))


def frontmatter_columns() -> dict[str, Column]:
    return {key: F.col(key) for key in FRONTMATTER_KEYS}
