"""Ranked substring search over the four text columns of a page.

A term matches as a case-insensitive substring of three or more characters. Scores are Okapi BM25 over
weighted occurrence counts; lower is better. Corpus statistics are always those of the whole collection: a
type filter only removes rows from the result.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelattice.functions.stage import staged
from notelattice.schema import (
    BM25_B,
    BM25_K1,
    DEFAULT_SEARCH_LIMIT,
    MAX_SEARCH_LIMIT,
    MIN_IDF,
    PREVIEW_CHARS,
    SEARCH_COLUMNS,
    SEARCH_WEIGHTS,
)

MIN_TERM_CHARS = 3
WORD = r"[\w\u0080-\U0010ffff\x1a]+\*?"


class QuerySyntaxError(ValueError):
    pass


def clean_query(query: str) -> str:
    """Text to match: a query with a hyphen becomes one quoted phrase, else quotes are dropped."""
    text = query.strip().replace("\0", "").strip()
    if "-" in text:
        return '"' + text.replace('"', '""') + '"'
    return text.replace('"', "")


def _is_phrase(text: str) -> bool:
    return text.startswith('"')


def query_words(part: str) -> list[str]:
    """Words of a blank-separated AND, lower case; an all-quoted text is one phrase."""
    if _is_phrase(part):
        return [part[1:-1].replace('""', '"').lower()]
    words = part.split()
    if not words or any(not re.fullmatch(WORD, w) or w in ("AND", "OR", "NOT") for w in words):
        raise QuerySyntaxError(part)
    # A trailing star asks for a prefix, which a substring match covers already.
    return [w.removesuffix("*").lower() for w in words]


def boolean_parts(text: str) -> list[list[list[list[str]]]]:
    """OR of ANDs of (first NOT second NOT ...) of words. Blank binds tightest, then NOT, AND, OR."""
    if _is_phrase(text):
        return [[[query_words(text)]]]

    def split(part: str, word: str) -> list[str]:
        return re.split(rf"(?:(?<=\s)|^){word}(?=\s|$)", part)

    return [
        [[query_words(words) for words in split(operand, "NOT")] for operand in split(alternative, "AND")]
        for alternative in split(text, "OR")
    ]


def search_table(pages: DataFrame) -> DataFrame:
    """Pages with lower-cased text columns ``_low_*`` and ``n_tokens``; write it once to serve many queries."""
    tokens = [F.greatest(F.char_length(F.coalesce(c, F.lit(""))) - 2, F.lit(0)) for c in SEARCH_COLUMNS]
    return staged(
        pages,
        {f"_low_{c}": F.lower(F.coalesce(F.col(c), F.lit(""))) for c in SEARCH_COLUMNS}
        | {"n_tokens": reduce(lambda a, b: a + b, tokens).cast("long")},
    )


def has_term(term: str) -> Column:
    """Does any text column contain the term?"""
    if len(term) < MIN_TERM_CHARS:
        return F.lit(False)
    return reduce(or_, [F.col(f"_low_{c}").contains(term) for c in SEARCH_COLUMNS])


def occurrences(column: str, term: str) -> Column:
    """Occurrences, overlapping ones included. Only a term that can overlap itself needs the look-ahead."""
    quoted = r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"
    overlaps = any(term[:n] == term[-n:] for n in range(1, len(term)))
    return F.regexp_count(F.col(column), F.lit(f"(?={quoted})" if overlaps else quoted))


def frequency(term: str, weights: tuple[float, ...]) -> Column:
    parts = [F.lit(w) * occurrences(f"_low_{c}", term) for c, w in zip(SEARCH_COLUMNS, weights, strict=True)]
    return reduce(lambda a, b: a + b, parts)


def idf(n_pages: Column, n_with_term: Column) -> Column:
    value = F.log((n_pages - n_with_term + 0.5) / (n_with_term + 0.5))
    return F.when(value > 0, value).otherwise(F.lit(MIN_IDF))


def term_score(freq: Column, weight: Column, n_tokens: Column, mean_tokens: Column) -> Column:
    damp = BM25_K1 * ((1 - BM25_B) + BM25_B * n_tokens / mean_tokens)
    return -weight * freq * (BM25_K1 + 1) / (freq + damp)


def _words_match(words: list[str]) -> Column:
    """AND of words. Words too short to hold a trigram are dropped, unless the operand has no other."""
    long = [w for w in words if len(w) >= MIN_TERM_CHARS]
    if not long:
        return F.lit(False)
    return reduce(and_, [has_term(w) for w in long])


def alternatives(parts: list[list[list[list[str]]]]) -> list[tuple[Column, list[str]]]:
    """(condition, scored words) of every OR alternative. Excluded words are never scored."""

    def operand(chain: list[list[str]]) -> Column:
        first, *excluded = [_words_match(words) for words in chain]
        return reduce(lambda kept, drop: kept & ~drop, excluded, first)

    return [
        (
            reduce(and_, [operand(chain) for chain in chains]),
            [w for chain in chains for w in chain[0] if len(w) >= MIN_TERM_CHARS],
        )
        for chains in parts
    ]


def search(
    pages: DataFrame,
    query: str,
    limit: int = DEFAULT_SEARCH_LIMIT,
    type_filter: str | None = None,
    sort: str | None = None,
    weights: tuple[float, ...] = SEARCH_WEIGHTS,
    on_invalid: str = "empty",
    max_limit: int = MAX_SEARCH_LIMIT,
) -> DataFrame:
    """``(slug, title, preview, rank)`` of the best ``limit`` pages, of at most ``max_limit``.

    Two column-pruned scans: one aggregate for the corpus statistics (a scalar subquery), one for the hits,
    ending in a per-partition top-k. ``search_page`` also tells how many pages matched.
    """
    hits = _filtered(pages, query, type_filter, weights, on_invalid)
    return _best(hits, limit, sort, max_limit).select("slug", "title", "preview", "rank")


def search_page(
    pages: DataFrame,
    query: str,
    limit: int = DEFAULT_SEARCH_LIMIT,
    type_filter: str | None = None,
    sort: str | None = None,
    weights: tuple[float, ...] = SEARCH_WEIGHTS,
    on_invalid: str = "empty",
    max_limit: int = MAX_SEARCH_LIMIT,
) -> DataFrame:
    """``search`` with ``position`` (from 1, in the order asked for) and ``total``, the number of matching pages."""
    hits = _filtered(pages, query, type_filter, weights, on_invalid)
    # The window sees no more than the rows of the result.
    place = F.row_number().over(Window.orderBy(*_order(sort), "slug")).cast("long")
    best = _best(hits, limit, sort, max_limit).withColumn("position", place)
    return best.withColumn("total", hits.agg(F.count("*")).scalar()).select(
        "position", "slug", "title", "preview", "rank", "total"
    )


def _filtered(
    pages: DataFrame, query: str, type_filter: str | None, weights: tuple[float, ...], on_invalid: str
) -> DataFrame:
    hits = ranked(pages, clean_query(query), weights, on_invalid)
    return hits.where(F.col("page_type") == type_filter) if type_filter and type_filter.strip() else hits


def _order(sort: str | None) -> list[Column]:
    return {"date": [F.desc("updated_at")], "title": [F.asc("title")]}.get(sort or "", [F.asc("rank")])


def _best(hits: DataFrame, limit: int, sort: str | None, max_limit: int) -> DataFrame:
    preview = F.left("compiled_truth", F.lit(PREVIEW_CHARS)).alias("preview")
    shown = hits.select("slug", "title", preview, "rank", "updated_at")
    return shown.orderBy(*_order(sort), "slug").limit(min(max(limit, 0), max_limit))


def ranked(
    pages: DataFrame, text: str, weights: tuple[float, ...] = SEARCH_WEIGHTS, on_invalid: str = "empty"
) -> DataFrame:
    """All matching pages with their ``rank``, unordered and unlimited."""
    nothing = pages.where(F.lit(False)).withColumn("rank", F.lit(None).cast("double"))
    if not text or not text.strip('"').strip():
        return nothing
    try:
        parts = boolean_parts(text)
    except QuerySyntaxError:
        if on_invalid == "raise":
            raise
        return nothing
    choices = alternatives(parts)
    terms = list(dict.fromkeys(w for _, words in choices for w in words))
    if not terms:
        return nothing
    table = pages if "n_tokens" in pages.columns else search_table(pages)
    stats = table.agg(
        F.struct(
            F.count("*").alias("n_pages"),
            F.avg("n_tokens").alias("mean_tokens"),
            F.array(*[F.count_if(has_term(t)) for t in terms]).alias("n_with"),
        ).alias("stats")
    ).scalar()
    condition = reduce(or_, [condition for condition, _ in choices])
    matched = table.where(condition).withColumn("_stats", stats)
    matched = matched.withColumns({f"_f{i}": frequency(t, weights) for i, t in enumerate(terms)})
    score = {
        t: F.when(
            F.col(f"_f{i}") > 0,
            term_score(
                F.col(f"_f{i}"),
                idf(F.col("_stats.n_pages"), F.col("_stats.n_with")[i]),
                F.col("n_tokens"),
                F.col("_stats.mean_tokens"),
            ),
        ).otherwise(0.0)
        for i, t in enumerate(terms)
    }
    # The words of an alternative count, repeated ones repeatedly, where that alternative holds.
    scores = []
    for condition, words in choices:
        total = reduce(lambda a, b: a + b, [score[w] for w in words], F.lit(0.0))
        scores.append(total if len(choices) == 1 else F.when(condition, total).otherwise(0.0))
    return matched.withColumn("rank", reduce(lambda a, b: a + b, scores)).select(*pages.columns, "rank")


def search_slugs(pages: DataFrame, query: str) -> DataFrame:
    """Unweighted search without clean-up or limit: slugs, best first. Bad syntax is an error."""
    hits = ranked(pages, query, weights=(1.0, 1.0, 1.0, 1.0), on_invalid="raise")
    return hits.orderBy("rank", "slug").select("slug")
