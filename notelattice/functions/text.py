"""Small text helpers and slug rules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelattice.schema import MAX_SLUG_BYTES, WHITESPACE


def trim_ws(c: Column) -> Column:
    """Strip Unicode white space (Spark's own ``trim`` strips only spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def trim_long(c: Column) -> Column:
    """``trim_ws`` of a stored column of long texts: trimming an end walks over the whole text, so it is looked at first."""
    blank = reduce(or_, [c.endswith(w) for w in WHITESPACE])
    return F.when(blank, trim_ws(c)).otherwise(F.ltrim(c, F.lit(WHITESPACE)))


def is_blank(c: Column) -> Column:
    return trim_ws(c) == ""


def text_from(c: Column, start: Column | int) -> Column:
    """The rest of ``c`` from the 1-based position ``start``."""
    return F.substr(c, F.lit(start) if isinstance(start, int) else start)


def slug_error(c: Column) -> Column:
    """Message of the first slug rule that fails, null for a valid slug."""
    n_bytes = F.octet_length(c)
    return (
        F.when(c == "", F.lit("slug must not be empty"))
        .when(
            n_bytes > MAX_SLUG_BYTES,
            F.concat(
                F.lit(f"slug exceeds maximum length of {MAX_SLUG_BYTES} characters (got "),
                n_bytes.cast("string"),
                F.lit(" characters)"),
            ),
        )
        .when(c.contains(".."), F.lit("slug must not contain '..' (path traversal)"))
        .when(c.startswith("/") | c.endswith("/"), F.lit("slug must not start or end with '/'"))
        .when(
            ~c.rlike(r"\A[A-Za-z0-9_./-]*\z"),
            F.concat(
                F.lit("slug '"),
                c,
                F.lit(
                    "' contains invalid characters: only ASCII alphanumeric, '-', '_', '/', and '.' are allowed"
                ),
            ),
        )
    )


def normalize_slug(c: Column) -> Column:
    """Strip one trailing ``.md``; null when nothing is left of it."""
    return F.when(c == ".md", F.lit(None)).when(
        c.endswith(".md"), F.substring(c, F.lit(1), F.char_length(c) - 3)
    ).otherwise(c)


def slug_to_path(c: Column) -> Column:
    return F.when(c.endswith(".md"), c).otherwise(F.concat(c, F.lit(".md")))


def strip_md_any_case(c: Column) -> Column:
    """Clean-up of stored slugs: unlike ``normalize_slug`` the extension may have any case."""
    return F.when(
        F.lower(c).endswith(".md"), F.substring(c, F.lit(1), F.char_length(c) - 3)
    ).otherwise(c)


def is_hidden(path: Column) -> Column:
    """The last path segment starts with a dot."""
    return F.substring_index(path, "/", -1).startswith(".")


def has_hidden_segment(path: Column) -> Column:
    """A hidden folder hides all below it, as it does in a recursive walk."""
    return path.rlike(r"(?:\A|/)\.")


def is_raw_path(path: Column) -> Column:
    return path.startswith("raw/")


def content_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def is_date_shape(c: Column) -> Column:
    """Ten characters ``dddd-dd-dd``; the calendar is not checked."""
    return c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
