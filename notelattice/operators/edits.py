"""Batch page edits: frontmatter merge, body replacement, timeline append, etag guard.

An edit guarded by an etag is checked against the hash its page has at that moment, that is after the
accepted edits before it. Each round therefore applies, for every page at once, all edits up to the next
guarded one that follows an accepted edit; the rest waits for the next round and the new hash. Batches
without such chains take one round. Within a round everything is an aggregation that combines before its
shuffle; nothing depends on the order of rows but the ``seq`` column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.functions.body import render_page
from notelattice.functions.frontmatter import json_object, json_string, merged_value, updates_error
from notelattice.functions.stage import built_once, staged
from notelattice.functions.text import content_hash, is_raw_path, normalize_slug, slug_error, slug_to_path
from notelattice.operators.parse import page_links, parse_notes, unique_links
from notelattice.operators.skew import hot_keys, if_small, salted_join
from notelattice.schema import DEFAULT_PAGE_TYPE, DEFAULT_VISIBILITY, FRONTMATTER_KEYS, PAGE_TYPES, PAGES
from notelattice.session import written

PAGE_COLUMNS = PAGES.fieldNames()
MESSAGES = {
    "raw_frontmatter": "frontmatter must not be provided for raw pages",
    "raw_timeline": "timeline must not be provided for raw pages",
    "timeline": "timeline.content is required for wiki pages",
    "frontmatter": "frontmatter is required when creating a new page",
    "title": "title is required in frontmatter for new pages",
    "blank_title": "title must not be empty for new pages",
    "no_seq": "seq is required",
    "repeated_seq": "seq repeats within the page",
    "slug": "normalizing slug would produce an empty string",
}


@dataclass
class EditOutcome:
    upserts: DataFrame  # pages as they are after the batch, touched ones only
    new_links: DataFrame  # out-links of the upserts
    raw_notes: DataFrame  # path, raw_content, content_hash: stored verbatim, not indexed
    results: DataFrame  # slug, seq, status (applied, conflict, rejected), message, and the page after the batch


def _request_error() -> Column:
    """Checks that look at the edit alone."""
    raw = is_raw_path(F.col("slug"))
    has_timeline = (F.coalesce("timeline_content", F.lit("")) != "") | F.col("timeline_agent").isNotNull()
    page_type = json_string(json_object(F.col("frontmatter"))["page_type"])
    return (
        F.when(F.col("slug").isNull(), F.lit(MESSAGES["slug"]))
        .when(raw & F.col("frontmatter").isNotNull(), F.lit(MESSAGES["raw_frontmatter"]))
        .when(raw & has_timeline, F.lit(MESSAGES["raw_timeline"]))
        .when(
            ~raw & ~page_type.isin(PAGE_TYPES),
            F.concat(
                F.lit("invalid page_type: '"), page_type, F.lit("'. Valid types: " + ", ".join(PAGE_TYPES))
            ),
        )
        .when(~raw & (F.coalesce("timeline_content", F.lit("")) == ""), F.lit(MESSAGES["timeline"]))
    )


@built_once
def _check_columns() -> dict[str, Column]:
    title = json_string(json_object(F.col("frontmatter"))["title"])
    create_error = (
        F.when(F.col("frontmatter").isNull(), F.lit(MESSAGES["frontmatter"]))
        .when(title.isNull(), F.lit(MESSAGES["title"]))
        .when(title == "", F.lit(MESSAGES["blank_title"]))
    )
    return {
        "request_error": _request_error(),
        "merge_error": F.coalesce(slug_error(F.col("slug")), updates_error(F.col("frontmatter"))),
        "create_error": create_error,
    }


def check_edits(edits: DataFrame) -> DataFrame:
    """Edits with normalised slug, ``request_error``, ``merge_error`` and ``create_error``."""
    return edits.withColumn("slug", normalize_slug(F.col("slug"))).withColumns(_check_columns())


def _decide(pending: DataFrame, pages: DataFrame) -> DataFrame:
    """Pending edits with ``status`` (applied, conflict, rejected, waiting) and ``message`` for one round."""
    hot = written(hot_keys(pending, "slug"), "hot")
    stored = pages.select("slug", F.col("content_hash").alias("_hash"))
    known = salted_join(pending, stored, "slug", "left", hot)
    exists = F.col("_hash").isNotNull()
    mismatch = exists & F.col("etag").isNotNull() & (F.col("etag") != F.col("_hash"))
    first_error = F.coalesce(F.when(~exists, F.col("create_error")), F.col("merge_error"))
    known = known.withColumns({"_mismatch": mismatch, "_error": first_error})
    passes = ~F.col("_mismatch") & F.col("_error").isNull()

    # Two numbers per page: the first edit that passes, and the first guarded one after it.
    first = known.groupBy("slug").agg(F.min(F.when(passes, F.col("seq"))).alias("_first"))
    known = salted_join(known, first, "slug", "left", hot)
    later = F.col("etag").isNotNull() & (F.col("seq") > F.col("_first"))
    cut = known.where(later).groupBy("slug").agg(F.min("seq").alias("_cut"))
    known = salted_join(known, cut, "slug", "left", hot)

    before = F.col("_first").isNull() | (F.col("seq") < F.col("_first"))
    etag_message = F.concat(F.lit("etag mismatch: expected "), F.col("etag"), F.lit(", got "), F.col("_hash"))
    status = (
        F.when(F.col("seq") >= F.col("_cut"), F.lit("waiting"))
        .when(before & F.col("_mismatch"), F.lit("conflict"))
        .when(before, F.lit("rejected"))
        .when(F.col("merge_error").isNotNull(), F.lit("rejected"))
        .otherwise(F.lit("applied"))
    )
    message = F.when(before & F.col("_mismatch"), etag_message).otherwise(
        F.when(before, F.col("_error")).otherwise(F.col("merge_error"))
    )
    known = known.withColumn("status", status)
    return known.withColumn("message", F.when(~F.col("status").isin("waiting", "applied"), message)).select(
        *pending.columns, "status", "message"
    )


def _fold(applied: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """Pages after the applied edits: last body, last value per given key, timeline in ``seq`` order."""
    given = staged(applied, {"_given": json_object(F.col("frontmatter"))})
    changed = given.groupBy("slug").agg(*_fold_columns().values())
    old = pages.select("slug", *FRONTMATTER_KEYS, "timeline", "created_at")
    joined = staged(changed.join(old, "slug", "left"), _merge_columns())
    rendered = joined.select("slug", "raw_content", F.coalesce("created_at", as_of).alias("created_at"))
    # The stored page is what the written note says, so it is parsed again.
    return parse_notes(rendered).withColumn("updated_at", as_of).select(*PAGE_COLUMNS, "parse_error")


@built_once
def _fold_columns() -> dict[str, Column]:
    entry = F.struct(
        "seq",
        F.col("as_of_date").alias("date"),
        F.lit(None).cast("string").alias("source_url"),
        F.col("timeline_content").alias("content"),
        F.col("timeline_agent").alias("agent"),
    )
    last_set = {
        f"_set_{k}": F.max_by(
            F.struct(F.col("_given")[k].alias("v")), F.when(F.map_contains_key("_given", k), F.col("seq"))
        ).alias(f"_set_{k}")
        for k in FRONTMATTER_KEYS
    }
    return last_set | {
        "_body": F.max_by("body", "seq").alias("_body"),
        # A page is one row, so its new entries meet here; the note text needs them all.
        "_entries": F.sort_array(F.collect_list(entry)).alias("_entries"),
    }


@built_once
def _merge_columns() -> dict[str, Column]:
    defaults = {
        "title": F.lit(""),
        "page_type": F.lit(DEFAULT_PAGE_TYPE),
        "visibility": F.lit(DEFAULT_VISIBILITY),
        "tags": F.array().cast("array<string>"),
        "sources": F.array().cast("array<string>"),
    }
    values = {}
    for key in FRONTMATTER_KEYS:
        existing = F.coalesce(F.col(key), defaults[key]) if key in defaults else F.col(key)
        update = F.when(F.col(f"_set_{key}").isNotNull(), F.create_map(F.lit(key), F.col(f"_set_{key}.v")))
        values[key] = merged_value(key, update, existing)
    appended = F.transform(
        "_entries", lambda e: F.struct(*[e[f].alias(f) for f in ("date", "source_url", "content", "agent")])
    )
    no_timeline = F.array().cast(PAGES["timeline"].dataType)
    timeline = F.concat(F.coalesce("timeline", no_timeline), appended)
    return {"raw_content": render_page(F.col("_body"), timeline, values)}


def _results(results: DataFrame, upserts: DataFrame, new_links: DataFrame, raw_notes: DataFrame) -> DataFrame:
    """What a caller gets for each edit: with the applied ones, the state of their page after the batch."""
    links = new_links.groupBy(F.col("source_slug").alias("slug")).agg(F.count("*").alias("links_count"))
    wiki = upserts.join(links, "slug", "left").select(
        "slug",
        "content_hash",
        F.lit(True).alias("indexed"),
        F.coalesce("links_count", F.lit(0)).alias("links_count"),
        F.size("timeline").cast("long").alias("timeline_count"),
    )
    none = F.lit(None).cast("long")
    raw = raw_notes.select(
        normalize_slug(F.col("path")).alias("slug"),
        "content_hash",
        F.lit(False).alias("indexed"),
        none.alias("links_count"),
        none.alias("timeline_count"),
    )
    state = wiki.unionByName(raw).withColumn("status", F.lit("applied"))
    return results.join(state, ["slug", "status"], "left").select(
        "slug", "seq", "status", "message", "content_hash", "indexed", "links_count", "timeline_count"
    )


def _with_order_errors(checked: DataFrame) -> DataFrame:
    """``request_error`` also for edits without ``seq`` and for those that share it with another edit of the page."""
    twice = checked.where("seq is not null").groupBy("slug", "seq").count().where("count > 1")
    twice = written(twice.select("slug", "seq", F.lit(True).alias("_twice")), "repeated-seq")
    marked = checked.join(if_small(twice), ["slug", "seq"], "left")
    error = F.coalesce(
        "request_error",
        F.when(F.col("seq").isNull(), F.lit(MESSAGES["no_seq"])),
        F.when(F.col("_twice"), F.lit(MESSAGES["repeated_seq"])),
    )
    return marked.withColumn("request_error", error).select(*checked.columns)


def apply_edits(pages: DataFrame, edits: DataFrame, as_of: Column) -> EditOutcome:
    """Apply ``edits`` (see the schema) to ``pages``; ``seq`` orders the edits of a page.

    The pages that the batch names are looked up once, in a semi join that a small batch broadcasts, and written;
    every round works on these alone. A page that does not parse after its edits stays as it was, and they are
    rejected.
    """
    checked = written(_with_order_errors(written(check_edits(edits), "checked")), "edits")
    refused = checked.where(F.col("request_error").isNotNull()).select(
        "slug", "seq", F.lit("rejected").alias("status"), F.col("request_error").alias("message")
    )
    good = checked.where(F.col("request_error").isNull())
    raw = good.where(is_raw_path(F.col("slug")))
    raw_notes = raw.groupBy(slug_to_path(F.col("slug")).alias("path")).agg(
        F.max_by("body", "seq").alias("raw_content")
    )
    raw_notes = raw_notes.withColumn("content_hash", content_hash(F.col("raw_content")))
    raw_results = raw.select(
        "slug", "seq", F.lit("applied").alias("status"), F.lit(None).cast("string").alias("message")
    )

    pending = good.where(~is_raw_path(F.col("slug")))
    named = written(pending.select("slug").distinct(), "named")
    state = written(pages.join(if_small(named), "slug", "left_semi").select(*PAGE_COLUMNS), "touched")
    rounds: list[DataFrame] = []
    results = [refused, raw_results]
    while True:
        decided = written(_decide(pending, state), "decided")
        folded = written(_fold(decided.where("status = 'applied'"), state, as_of), "folded")
        broken = folded.where("parse_error is not null").select("slug", F.col("parse_error").alias("_broken"))
        told = decided.where("status != 'waiting'").join(broken, "slug", "left")
        undone = (F.col("status") == "applied") & F.col("_broken").isNotNull()
        results.append(
            told.select(
                "slug",
                "seq",
                F.when(undone, F.lit("rejected")).otherwise(F.col("status")).alias("status"),
                F.when(undone, F.col("_broken")).otherwise(F.col("message")).alias("message"),
            )
        )
        rounds.append(folded.where("parse_error is null").select(*PAGE_COLUMNS))
        pending = decided.where("status = 'waiting'").select(*checked.columns)
        if pending.isEmpty():
            break
        # A waiting edit follows an applied one, so its page is among these, unless it did not parse.
        state = rounds[-1].unionByName(state.join(broken, "slug", "left_semi"))

    upserts = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        upserts = upserts.unionByName(earlier.join(upserts.select("slug"), "slug", "left_anti"))
    new_links = unique_links(page_links(upserts))
    return EditOutcome(
        upserts=upserts,
        new_links=new_links,
        raw_notes=raw_notes,
        results=_results(reduce(DataFrame.unionByName, results), upserts, new_links, raw_notes),
    )
