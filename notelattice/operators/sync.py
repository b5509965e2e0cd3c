"""Snapshot sync: bring the page and link tables in step with a listing of notes, by content hash."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.functions.text import content_hash, is_raw_path, normalize_slug, slug_to_path, strip_md_any_case
from notelattice.operators.parse import page_links, parse_notes, repeated_link_sources, unique_links
from notelattice.operators.skew import BROADCAST_BYTES, first_per_key, if_small, salted_join
from notelattice.schema import LINKS, MAX_WALK_DEPTH, PAGES
from notelattice.session import TEXT_CODEC, written
from notelattice.sources.notes import delete_notes, too_deep, walk

REMOVALS = ("all", "scoped", "none")
PAGE_COLUMNS = PAGES.fieldNames()
LINK_COLUMNS = LINKS.fieldNames()


@dataclass
class SyncOutcome:
    status: DataFrame  # slug, path, status
    upserts: DataFrame  # new and changed pages
    removed: DataFrame  # slug
    new_links: DataFrame  # links of the upserts
    pages: DataFrame  # the new page table
    links: DataFrame  # the new link table
    errors: DataFrame  # path, stage, message
    counts: DataFrame  # one row


def _listing(notes: DataFrame, directory: str, markdown_only: bool, max_depth: int | None) -> DataFrame:
    """One row per slug: ``(slug, path, _new_hash, copies, fetch_failed)``.

    Of several arrivals of a slug the one with content wins, then the one with the highest ``seq`` (if notes have
    one), then ``.md`` paths, then the smaller path. Only slugs, paths and hashes are grouped.
    """
    seq = F.col("seq") if "seq" in notes.columns else F.lit(0)
    listed = walk(notes, directory, markdown_only, max_depth).select(
        normalize_slug(F.col("path")).alias("slug"),
        "path",
        content_hash(F.col("raw_content")).alias("_new_hash"),
        seq.cast("long").alias("seq"),
    )
    order = F.struct(F.col("_new_hash").isNull(), -F.coalesce("seq", F.lit(0)), ~F.col("path").endswith(".md"), "path", "_new_hash")
    return (
        listed.groupBy("slug")
        .agg(
            F.min_by(F.struct("path", "_new_hash"), order).alias("_first"),
            F.count("*").alias("copies"),
            F.max(F.col("_new_hash").isNull()).alias("fetch_failed"),
        )
        .select("slug", "_first.*", "copies", "fetch_failed")
    )


def _below(slug: Column, folders: DataFrame, missing: DataFrame) -> DataFrame:
    """Slugs of ``missing(slug)`` that lie below one of ``folders(folder)``, at any depth."""
    parts = F.split(slug, "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spread = missing.select("slug", F.explode(ups).alias("folder"))
    named = folders.select(F.when(F.col("folder") == ".", F.lit("")).otherwise(F.col("folder")).alias("folder")).distinct()
    return spread.join(named, "folder", "left_semi").select("slug").distinct()


def classify(
    pages: DataFrame,
    notes: DataFrame,
    directory: str = "wiki",
    removals: str = "all",
    markdown_only: bool = True,
    max_depth: int | None = MAX_WALK_DEPTH,
    incomplete: DataFrame | None = None,
) -> DataFrame:
    """One row per slug: ``(slug, path, status, created_at, hash, copies, fetch_failed)``.

    The status is new, changed, unchanged, failed, removed or kept. ``notes(path, raw_content)`` lists the snapshot;
    a null content is a failed fetch, which keeps its page. Only slugs and hashes are shuffled, never text.
    ``removals``: pages missing from the listing go all, or only those below ``directory`` ("scoped"), or never
    ("none": a stream cannot see deletions). Whatever it says, a page is kept if the listing could not show it:
    below more than ``max_depth`` folders, or below one of ``incomplete(folder)``.
    """
    if removals not in REMOVALS:
        raise ValueError(f"removals must be one of {', '.join(REMOVALS)}")
    listed = _listing(notes, directory, markdown_only, max_depth)
    stored = pages.select("slug", F.col("content_hash").alias("_old_hash"), "created_at")
    gone: Column = F.lit(removals != "none")
    if removals == "scoped":
        gone = F.col("slug").startswith(directory.rstrip("/") + "/")
    if max_depth is not None:
        gone = gone & ~too_deep(F.col("slug"), directory, max_depth)
    how = "left" if removals == "none" else "full_outer"
    joined = listed.join(stored, "slug", how)
    if incomplete is not None and removals != "none":
        unseen = _below(F.col("slug"), incomplete, stored).withColumn("_unseen", F.lit(True))
        joined = joined.join(unseen, "slug", "left")
        gone = gone & F.col("_unseen").isNull()
    status = (
        F.when(F.col("path").isNull(), F.when(gone, F.lit("removed")).otherwise(F.lit("kept")))
        .when(F.col("_new_hash").isNull(), F.lit("failed"))
        .when(F.col("_old_hash").isNull(), F.lit("new"))
        .when(F.col("_old_hash") != F.col("_new_hash"), F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    return joined.select(
        "slug",
        "path",
        status.alias("status"),
        "created_at",
        F.col("_new_hash").alias("hash"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("fetch_failed", F.lit(False)).alias("fetch_failed"),
    )


def parse_changes(notes: DataFrame, status: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Parse only new and changed notes. ``notes`` is scanned once more instead of shuffling all its text.

    The changed paths are written and measured; up to ``broadcast_bytes`` they are broadcast and the text stays
    where it is. A larger set is joined by shuffle: then most of the text has to be parsed anyway.
    """
    todo = written(
        status.where(F.col("status").isin("new", "changed")).select("slug", "path", "created_at", "hash", "copies"),
        "todo",
    )
    hits = notes.select("path", "raw_content").join(if_small(todo, broadcast_bytes), "path")
    single = hits.where("copies = 1").drop("copies", "hash")
    if todo.where("copies > 1").isEmpty():
        return parse_notes(single)
    # A path that arrived several times: only the arrival that won, once. A slug has one path here, and by path the rows
    # of a larger set lie together since the join, so their text isn't moved or sorted again.
    several = hits.where("copies > 1").where(content_hash(F.col("raw_content")) == F.col("hash"))
    once = first_per_key(several.drop("copies", "hash"), ["path"], F.col("slug"))
    return parse_notes(single.unionByName(once))


def upsert_pages(pages: DataFrame, upserts: DataFrame) -> DataFrame:
    """Insert or replace by slug; every column is replaced except ``created_at`` of a known page."""
    known = pages.select("slug", F.col("created_at").alias("_created"))
    fresh = (
        upserts.join(known, "slug", "left")
        .withColumn("created_at", F.coalesce("_created", "created_at"))
        .select(*PAGE_COLUMNS)
    )
    return pages.join(upserts.select("slug"), "slug", "left_anti").select(*PAGE_COLUMNS).unionByName(fresh)


def drop_links(links: DataFrame, slugs: DataFrame, end: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Links whose ``end`` (source_slug or target_slug) is not in ``slugs(slug)``.

    The slugs are written and measured. A small set is broadcast and no link moves; a larger one is joined by
    shuffle, with hubs spread over salts.
    """
    gone = written(slugs.select(F.col("slug").alias(end)).distinct(), "gone")
    small = if_small(gone, broadcast_bytes)
    if small is not gone:
        return links.join(small, end, "left_anti").select(*LINK_COLUMNS)
    return salted_join(links, gone, end, "left_anti").select(*LINK_COLUMNS)


def replace_links(links: DataFrame, sources: DataFrame, new_links: DataFrame) -> DataFrame:
    """Replace all out-links of every page in ``sources(slug)``."""
    return drop_links(links, sources, "source_slug").unionByName(new_links.select(*LINK_COLUMNS))


def remove_pages(pages: DataFrame, links: DataFrame, slugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete pages and every link from or to them."""
    gone = slugs.select("slug").distinct()
    kept = drop_links(drop_links(links, gone, "source_slug"), gone, "target_slug")
    return pages.join(gone, "slug", "left_anti"), kept


def delete_pages(
    notes: DataFrame, pages: DataFrame, links: DataFrame, slugs: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batch page.delete: (notes, pages, links) without ``slugs(slug)``; raw notes are in no index."""
    named = slugs.select(normalize_slug(F.col("slug")).alias("slug"))
    left = delete_notes(notes, named.select(slug_to_path(F.col("slug")).alias("path")))
    return left, *remove_pages(pages, links, named.where(~is_raw_path(F.col("slug"))))


def sync(
    pages: DataFrame,
    links: DataFrame,
    notes: DataFrame,
    as_of: Column,
    directory: str = "wiki",
    removals: str = "all",
    on_duplicate: str = "first",
    markdown_only: bool = True,
    max_depth: int | None = MAX_WALK_DEPTH,
    incomplete: DataFrame | None = None,
) -> SyncOutcome:
    """Diff, re-parse what changed, upsert, replace links, remove.

    ``on_duplicate="reject"`` keeps the old links of a page that holds one link twice and reports it. Every row
    of the listing that does not end in a page is in ``errors``: stage fetch, parse, walk (deeper than
    ``max_depth`` folders), duplicate (another path has its slug), list (``incomplete`` folders) or links. The
    classification (slugs only) and the parsed changes are written as tables, because several results read
    different columns of them.
    """
    status = written(classify(pages, notes, directory, removals, markdown_only, max_depth, incomplete), "status")
    parsed = written(
        parse_changes(notes, status).withColumns(
            {"created_at": F.coalesce("created_at", as_of), "updated_at": as_of}
        ),
        "parsed",
        **TEXT_CODEC,
    )
    upserts = parsed.where(F.col("parse_error").isNull()).select(*PAGE_COLUMNS)
    removed = status.where("status = 'removed'").select("slug")

    found = page_links(upserts)
    relinked = upserts.select("slug")
    errors = _errors(status, parsed).unionByName(
        unlisted(status, notes, directory, markdown_only, max_depth, incomplete)
    )
    if on_duplicate == "reject":
        repeated = repeated_link_sources(found)
        relinked = relinked.join(repeated, "slug", "left_anti")
        found = found.withColumnRenamed("source_slug", "slug").join(repeated, "slug", "left_anti")
        found = found.withColumnRenamed("slug", "source_slug")
        errors = errors.unionByName(
            repeated.select(
                slug_to_path(F.col("slug")).alias("path"),
                F.lit("links").alias("stage"),
                F.concat(F.lit("failed to update links for "), F.col("slug"), F.lit(": repeated link")).alias("message"),
            )
        )
    new_links = unique_links(found)

    kept = pages.join(upserts.select("slug").unionByName(removed), "slug", "left_anti").select(*PAGE_COLUMNS)
    kept_links = drop_links(links, relinked.unionByName(removed), "source_slug")
    counts = upserts.agg(F.count("*").alias("pages_indexed")).select(
        F.col("pages_indexed").alias("files_changed"),
        "pages_indexed",
        removed.agg(F.count("*")).scalar().alias("pages_removed"),
        new_links.agg(F.count("*")).scalar().alias("links_updated"),
        errors.agg(F.count("*")).scalar().alias("n_errors"),
    )
    return SyncOutcome(
        status=status.select("slug", "path", "status"),
        upserts=upserts,
        removed=removed,
        new_links=new_links,
        pages=kept.unionByName(upserts),
        # Removal comes last, so it also takes new links to a removed page.
        links=drop_links(kept_links.unionByName(new_links), removed, "target_slug"),
        errors=errors,
        counts=counts,
    )


def _errors(status: DataFrame, parsed: DataFrame) -> DataFrame:
    fetch = status.where("fetch_failed").select(
        "path", F.lit("fetch").alias("stage"), F.concat(F.lit("failed to fetch "), F.col("path")).alias("message")
    )
    parse = parsed.where(F.col("parse_error").isNotNull()).select(
        "path",
        F.lit("parse").alias("stage"),
        F.concat(F.lit("failed to parse "), F.col("path"), F.lit(": "), F.col("parse_error")).alias("message"),
    )
    return fetch.unionByName(parse)


def unlisted(
    status: DataFrame,
    notes: DataFrame,
    directory: str,
    markdown_only: bool,
    max_depth: int | None,
    incomplete: DataFrame | None,
) -> DataFrame:
    """Errors of notes that are listed but take no part, and of folders whose listing is not whole."""
    deep = walk(notes, directory, markdown_only, None)
    deep = deep.where(too_deep(F.col("path"), directory, max_depth) if max_depth is not None else F.lit(False))
    errors = deep.select(
        "path",
        F.lit("walk").alias("stage"),
        F.concat(F.lit(f"more than {max_depth} folders deep: "), F.col("path")).alias("message"),
    )
    winners = status.where("copies > 1").select("slug", F.col("path").alias("_winner"))
    listed = walk(notes, directory, markdown_only, max_depth).select(normalize_slug(F.col("path")).alias("slug"), "path")
    others = listed.join(winners, "slug").where("path != _winner").distinct()
    errors = errors.unionByName(
        others.select(
            "path",
            F.lit("duplicate").alias("stage"),
            F.concat(F.lit("same slug as "), F.col("_winner"), F.lit(": "), F.col("path")).alias("message"),
        )
    )
    if incomplete is not None:
        errors = errors.unionByName(
            incomplete.select(
                F.col("folder").alias("path"),
                F.lit("list").alias("stage"),
                F.concat(F.lit("incomplete listing of "), F.col("folder")).alias("message"),
            ).distinct()
        )
    return errors


def batch_errors(
    status: DataFrame,
    parsed: DataFrame,
    notes: DataFrame,
    directory: str = "wiki",
    max_depth: int | None = MAX_WALK_DEPTH,
) -> DataFrame:
    """All errors of one batch of arriving notes."""
    return _errors(status, parsed).unionByName(unlisted(status, notes, directory, True, max_depth, None))


def reindex(
    notes: DataFrame,
    as_of: Column,
    directory: str = "wiki",
    markdown_only: bool = True,
    max_depth: int | None = MAX_WALK_DEPTH,
    incomplete: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, links, errors) built from scratch: no diff, one parse of every note.

    Slugs are unique and errors are complete as in ``sync``. Only the slugs that arrived more than once are joined to
    the notes, broadcast up to a measured size; all other text is scanned where it is.
    """
    status = written(_listing(notes, directory, markdown_only, max_depth), "listing")
    repeated = written(
        status.where("copies > 1").select("slug", F.col("path").alias("_winner"), F.col("_new_hash").alias("_hash")), "repeated"
    )
    listed = walk(notes, directory, markdown_only, max_depth).withColumn("slug", normalize_slug(F.col("path")))
    fetched = listed.where(F.col("raw_content").isNotNull())
    if not repeated.isEmpty():
        few = if_small(repeated)
        alone = fetched.join(few.select("slug") if few is repeated else F.broadcast(repeated.select("slug")), "slug", "left_anti")
        won = (F.col("path") == F.col("_winner")) & (content_hash(F.col("raw_content")) == F.col("_hash"))
        several = fetched.join(few, "slug").where(won).select(*fetched.columns)
        fetched = alone.unionByName(first_per_key(several, ["slug"], F.col("path")))
    parsed = parse_notes(fetched).withColumns({"created_at": as_of, "updated_at": as_of})
    good = parsed.where(F.col("parse_error").isNull()).select(*PAGE_COLUMNS)
    errors = _errors(status, parsed).unionByName(
        unlisted(status, notes, directory, markdown_only, max_depth, incomplete)
    )
    return good, unique_links(page_links(good)), errors


def clean_slugs(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strip ``.md`` from stored slugs. Rows that become equal combine: latest page, first link.

    Slugs that collide are found from slugs alone; only their pages are combined, all others stay where they are.
    """
    tidy_pages = pages.withColumn("slug", strip_md_any_case(F.col("slug")))
    tidy_links = links.withColumns(
        {end: strip_md_any_case(F.col(end)) for end in ("source_slug", "target_slug")}
    )
    newest = -F.unix_micros(F.coalesce("updated_at", F.timestamp_seconds(F.lit(0))))
    keys = ["source_slug", "target_slug", "link_type"]
    collide = written(tidy_pages.groupBy("slug").count().where("count > 1").select("slug"), "collisions")
    few = if_small(collide)
    alone = tidy_pages.join(few, "slug", "left_anti")
    combined = first_per_key(tidy_pages.join(few, "slug", "left_semi"), ["slug"], newest)
    return (
        alone.select(*tidy_pages.columns).unionByName(combined),
        first_per_key(tidy_links, keys, F.coalesce("context_snippet", F.lit(""))),
    )
