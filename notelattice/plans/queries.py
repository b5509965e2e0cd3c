"""Registered queries: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelattice.functions import text as X
from notelattice.operators import batch_search as batch
from notelattice.operators import edits as E
from notelattice.operators import file_sync as FS
from notelattice.operators import graph as G
from notelattice.operators import lookup as L
from notelattice.operators import quality as Q
from notelattice.operators import search as S
from notelattice.operators import search_index as SI
from notelattice.operators import similarity, tags
from notelattice.operators import sync as Y
from notelattice.operators import timeline as TL
from notelattice.operators.parse import page_links, parse_notes, unique_links
from notelattice.plans import fixtures as fx
from notelattice.schema import LINKS, PAGES
from notelattice.session import TEXT_CODEC, scratch_path, written
from notelattice.sources import envelopes as V
from notelattice.sources import files as FI
from notelattice.sources import notes as N
from notelattice.sources.notes import walk
from notelattice.sources.tables import read_version, write_version
from notelattice.streaming import edits as stream_edits
from notelattice.streaming import sync as stream_sync

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def _hits(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.round("rank", 8))


def _search(name: str, query: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _hits(S.search(fx.texts(spark, sf_dir), query, **options))

    run.__name__ = name
    register(run)


_search("search_relevance", "tion", limit=50)
_search("search_overlap", "ere", limit=100)
_search("search_title_sort", "tion", sort="title", limit=25)
_search("search_date_sort", "ment", sort="date", limit=25)
_search("search_type_filter", "tion", type_filter="Source", limit=100)
_search("search_and", "tion note", limit=100)
_search("search_or", "keit OR ment AND note", limit=100)
_search("search_not", "tion NOT ment", limit=100)
_search("search_phrase", "src1-note 0", limit=100)


@register
def search_page(spark, sf_dir):
    """Positions and the number of all matches, in the order of the title."""
    found = S.search_page(fx.texts(spark, sf_dir), "tion", sort="title", limit=25)
    return found.select("position", "slug", "total")


@register
def search_edge_cases(spark, sf_dir):
    """Hits of blank, too short and malformed queries, next to a good one."""
    texts = fx.texts(spark, sf_dir)
    asked = {"blank": "  ", "quotes": '""', "short": "ti", "malformed": "title:tion", "good": "tion"}
    counts = [S.search(texts, q, limit=100).agg(F.count("*").alias("n_hits")).withColumn("query", F.lit(k)) for k, q in asked.items()]
    found = tags.search_tags(fx.pages(spark, sf_dir), [], "or")
    counts.append(found.agg(F.count("*").alias("n_hits")).withColumn("query", F.lit("no tags")))
    return reduce(DataFrame.unionByName, counts)


@register
def search_unweighted(spark, sf_dir):
    return S.search_slugs(fx.texts(spark, sf_dir), "tion OR keit")


@register
def search_batch(spark, sf_dir):
    hits = batch.batch_search(fx.texts(spark, sf_dir), fx.queries(spark, sf_dir), limit=10)
    return hits.withColumn("rank", F.round("rank", 6))


@register
def search_batch_status(spark, sf_dir):
    """Which benchmark queries have words too short to search for."""
    words = F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\s]", " "), r"\s+")
    asked = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("terms"))
    return batch.query_status(asked)


@register
def search_after_sync(spark, sf_dir):
    """Search over the pages that a sync left, through a stored search table."""
    pages = _synced(spark, sf_dir).pages
    return S.search_slugs(written(S.search_table(pages), "search-table"), "tion OR keit")


@register
def trigram_postings(spark, sf_dir):
    found = batch.trigram_postings(fx.texts(spark, sf_dir))
    return found.groupBy("trigram", "column").agg(
        F.count("*").alias("n_pages"), F.sum("tf").alias("n_occurrences")
    )


def _index_after_changes(spark, sf_dir):
    """An index of the stored pages, after a sync and after a batch that rewrites some pages and removes others."""
    stored = _index(spark, sf_dir)
    index = SI.create(stored[0], scratch_path(spark, "search-index"), slots=16, buckets=16)
    outcome = _synced(spark, sf_dir, stored)
    index = SI.apply(index, outcome.upserts, outcome.removed)
    later = outcome.pages
    revised = later.where("slug like '%3'").withColumn("title", F.concat(F.lit("Revised "), F.col("title")))
    return SI.apply(index, revised, later.where("slug like '%7'").select("slug"))


def _index_content(index):
    """Pages of every trigram by the running counts and by the postings, and its occurrences."""
    places = SI.live_entries(index).groupBy("trigram").agg(
        F.count_if("first").alias("n_listed"), F.sum("tf").alias("n_occurrences")
    )
    return index.trigram_counts().join(places, "trigram", "full_outer")


@register
def search_index_sync(spark, sf_dir):
    """The trigram index kept in step through a sync and a batch of changes: equal to one built anew."""
    return _index_content(_index_after_changes(spark, sf_dir))


@register
def search_index_merged(spark, sf_dir):
    """The same after its segments were merged."""
    return _index_content(SI.merge(_index_after_changes(spark, sf_dir)))


@register
def search_index_stats(spark, sf_dir):
    """Running collection statistics of the index after the changes."""
    return _index_after_changes(spark, sf_dir).stats()


@register
def search_index_batch(spark, sf_dir):
    """Batch search through the stored index, a third of whose pages were rewritten and some removed since it was built."""
    texts = fx.texts(spark, sf_dir)
    third = F.crc32(F.col("slug").cast("binary")) % 3 == 0
    stale = texts.withColumn("compiled_truth", F.when(third, F.lit("nothing of the later text")).otherwise(F.col("compiled_truth")))
    gone = texts.where(third).withColumn("slug", F.concat(F.lit("gone/"), "slug"))
    index = SI.create(stale.unionByName(gone), scratch_path(spark, "search-index"))
    index = SI.apply(index, texts.where(third), gone.select("slug"))
    return SI.search_index(index, fx.queries(spark, sf_dir), limit=10).withColumn("rank", F.round("rank", 6))


@register
def page_lookup(spark, sf_dir):
    cited = fx.links(spark, sf_dir).where("link_type = 'cites'").select(F.col("target_slug").alias("slug"))
    return L.get_pages(fx.rendered_pages(spark, sf_dir), cited).select("slug", "title", "page_type", "content_hash")


@register
def page_view(spark, sf_dir):
    both = fx.notes(spark, sf_dir).unionByName(fx.raw_notes(spark, sf_dir))
    return L.page_view(both).select(
        "slug",
        F.col("frontmatter.title").alias("title"),
        F.array_join("frontmatter.tags", "|").alias("tags"),
        "body",
        F.size("timeline").cast("long").alias("n_entries"),
        "content_hash",
        "error",
    )


@register
def page_list(spark, sf_dir):
    both = fx.notes(spark, sf_dir).unionByName(fx.raw_notes(spark, sf_dir))
    top = L.list_dir(both, ".")
    return top.unionByName(L.list_dir(both, "wiki")).unionByName(L.list_dir(both, "wiki/7"))


@register
def note_walk(spark, sf_dir):
    """Listing with hidden folders, deep folders and other file types among the paths."""
    docs = fx.table(spark, sf_dir, "documents")
    folder = (
        F.when(F.col("source") == "src1", F.lit("wiki/.trash/"))
        .when(F.col("source") == "src2", F.lit("wiki/a/b/c/d/e/f/g/h/i/j/"))
        .when(F.col("source") == "src3", F.lit("wiki/a/b/c/d/e/f/g/h/i/j/k/"))
        .when(F.col("source") == "src4", F.lit("raw/"))
        .otherwise(F.lit("wiki/"))
    )
    name = F.when(F.col("lang") == "de", F.lit(".")).otherwise(F.lit(""))
    ending = F.when(F.col("lang") == "fr", F.lit(".txt")).otherwise(F.lit(".md"))
    listed = docs.select(
        F.concat(folder, name, F.col("doc_id").cast("string"), ending).alias("path"), F.col("text").alias("raw_content")
    )
    return walk(listed).select("path", X.content_hash(F.col("raw_content")).alias("content_hash"))


@register
def has_link_batch(spark, sf_dir):
    links = fx.links(spark, sf_dir)
    back = links.select(F.col("target_slug").alias("source_slug"), F.col("source_slug").alias("target_slug")).distinct()
    return L.has_link_batch(links, back)


@register
def stats(spark, sf_dir):
    one = L.collection_stats(fx.pages(spark, sf_dir), fx.links(spark, sf_dir))
    kinds = ["Entity", "Concept", "Source", "Query", "Synthesis", "Comparison"]
    return one.select(
        "total_pages",
        *[F.col("pages_by_type")[k].alias(f"n_{k.lower()}") for k in kinds],
        "total_links",
        "orphan_count",
    )


@register
def pages_by_type(spark, sf_dir):
    return L.pages_by_type(fx.graph_pages(spark, sf_dir))


@register
def tags_list(spark, sf_dir):
    return tags.list_tags(fx.pages(spark, sf_dir))


def _tag_hits(df):
    return df.withColumn("tags", F.array_join("tags", "|"))


@register
def tags_or(spark, sf_dir):
    return _tag_hits(tags.search_tags(fx.pages(spark, sf_dir), ["de", "quality", "src7"], "or"))


@register
def tags_and(spark, sf_dir):
    return _tag_hits(tags.search_tags(fx.pages(spark, sf_dir), ["en", "quality", "en"], "and"))


@register
def outlinks(spark, sf_dir):
    return G.outlinks(fx.graph_links(spark, sf_dir), "order/7")


@register
def backlinks(spark, sf_dir):
    return G.backlinks(fx.graph_links(spark, sf_dir), "nation/7", "in")


@register
def links_both(spark, sf_dir):
    return G.link_view(G.direct_links(fx.graph_links(spark, sf_dir), "customer/7", "both"))


@register
def links_of_orphans(spark, sf_dir):
    """Out-links of every page that nothing links to."""
    links = fx.graph_links(spark, sf_dir)
    starts = G.orphans(fx.graph_pages(spark, sf_dir), links)
    return G.batch_direct_links(links, starts, "out").select("source_slug", "target_slug", "link_type")


@register
def neighbors_out(spark, sf_dir):
    return G.neighbors(written(fx.links(spark, sf_dir), "links"), "wiki/1/1", depth=6)


@register
def neighbors_in(spark, sf_dir):
    return G.neighbors(written(fx.graph_links(spark, sf_dir), "links"), "region/1", depth=3, direction="in")


def _customers(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("slug"))


@register
def neighbors_many(spark, sf_dir):
    """Everything within three out-links of each customer, all searched from together."""
    return G.neighbors_many(written(fx.graph_links(spark, sf_dir), "links"), _customers(spark, sf_dir), depth=3)


@register
def neighbors_reach(spark, sf_dir):
    """How many pages each customer reaches in one and two links of any direction."""
    return G.reach(fx.graph_links(spark, sf_dir), _customers(spark, sf_dir), depth=2, direction="both")


@register
def neighbors_both(spark, sf_dir):
    return G.neighbors(written(fx.links(spark, sf_dir), "links"), "wiki/1/1", depth=4, link_type="cites", direction="both")


@register
def graph_query(spark, sf_dir):
    """Direct links and neighbours of one page."""
    direct, near = G.graph_query(written(fx.graph_links(spark, sf_dir), "links"), "customer/7", depth=2, direction="both")
    rows = direct.select("source_slug", "target_slug", "link_type")
    return rows.unionByName(near.select(F.lit("customer/7").alias("source_slug"), F.col("slug").alias("target_slug"), F.col("distance").cast("string").alias("link_type")))


@register
def orphans(spark, sf_dir):
    return G.orphans(fx.graph_pages(spark, sf_dir), fx.graph_links(spark, sf_dir))


@register
def link_types(spark, sf_dir):
    return G.link_types(fx.graph_links(spark, sf_dir))


@register
def shared_links(spark, sf_dir):
    return G.shared_links(fx.graph_links(spark, sf_dir), "order/1", "order/2")


@register
def shared_links_batch(spark, sf_dir):
    """What consecutive orders of a customer share."""
    orders = fx.table(spark, sf_dir, "orders")
    earlier = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    slug = lambda c: F.concat(F.lit("order/"), c.cast("string"))
    pairs = (
        orders.select(slug(earlier).alias("slug_a"), slug(F.col("o_orderkey")).alias("slug_b"))
        .where(F.col("slug_a").isNotNull())
    )
    return G.shared_links_batch(fx.graph_links(spark, sf_dir), pairs)


@register
def shared_links_top(spark, sf_dir):
    """All pages that share two targets and more."""
    return G.shared_link_pairs(fx.graph_links(spark, sf_dir), min_shared=2)


@register
def shared_links_near(spark, sf_dir):
    """Pages that share two targets and a third of both; small blocks, so that popular targets are cut."""
    return G.shared_link_pairs(fx.graph_links(spark, sf_dir), min_shared=2, min_jaccard=1 / 3, block_rows=16)


@register
def lint(spark, sf_dir):
    return Q.lint(fx.pages(spark, sf_dir))


@register
def broken_links(spark, sf_dir):
    return Q.broken_links(fx.pages(spark, sf_dir), fx.links(spark, sf_dir))


@register
def maintain_full(spark, sf_dir):
    return Q.maintain(fx.pages(spark, sf_dir), fx.links(spark, sf_dir), "full")


@register
def issue_counts(spark, sf_dir):
    return Q.issue_counts(Q.maintain(fx.pages(spark, sf_dir), fx.links(spark, sf_dir), "full"))


@register
def listing_json(spark, sf_dir):
    """Counts of a folder's children as JSON texts."""
    return L.json_rows(L.listing_counts(fx.raw_notes(spark, sf_dir), "raw"))


@register
def slug_checks(spark, sf_dir):
    """Rules and conversions on page addresses and document slugs."""
    urls = fx.table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("slug"))
    slugs = fx.table(spark, sf_dir, "documents").select(
        F.concat(fx.text_slug(F.col("doc_id")), F.when(F.col("lang") == "en", F.lit(".md")).otherwise(F.lit(""))).alias("slug")
    )
    c = F.col("slug")
    return urls.unionByName(slugs).select(
        "slug",
        X.slug_error(c).alias("error"),
        X.normalize_slug(c).alias("normalized"),
        X.slug_to_path(c).alias("path"),
        X.is_hidden(c).alias("hidden"),
        X.is_raw_path(c).alias("raw"),
    )


def _parsed(spark, sf_dir):
    listed = fx.notes(spark, sf_dir).withColumn("slug", X.normalize_slug(F.col("path")))
    return parse_notes(listed)


@register
def parse_roundtrip(spark, sf_dir):
    good = _parsed(spark, sf_dir).where(F.col("parse_error").isNull())
    return good.select(
        "slug",
        "title",
        "page_type",
        F.array_join("tags", "|").alias("tags"),
        F.array_join("sources", "|").alias("sources"),
        "date",
        "visibility",
        "created_by",
        "compiled_truth",
        "timeline_text",
        F.size("timeline").cast("long").alias("n_entries"),
    )


#: Beginnings of titles and tags that only a quoted scalar can hold.
AWKWARD = ["C:\\new ", 'say "x" ', "it's ", "tab\tand\nline ", "a: b # ", "é日本 ", "\\\\", "- ", "\x07\x85 "]


@register
def frontmatter_escapes(spark, sf_dir):
    """Titles and tags with backslashes, quotes, white space and control characters, rendered and parsed again."""
    texts = F.array(*[F.lit(x) for x in AWKWARD])
    nth = lambda k: F.element_at(texts, ((F.col("doc_id") + k) % len(AWKWARD) + 1).cast("int"))
    written = fx.pages(spark, sf_dir).withColumns(
        {"title": F.concat(nth(0), "source"), "tags": F.array(F.concat(nth(1), "lang"), F.concat("source", nth(2)))}
    )
    parsed = parse_notes(fx.render_notes(written).select("slug", "raw_content"))
    return parsed.select("slug", "title", F.array_join("tags", "|").alias("tags"))


@register
def parse_errors(spark, sf_dir):
    return _parsed(spark, sf_dir).where(F.col("parse_error").isNotNull()).select("path", "parse_error")


@register
def timeline_entries(spark, sf_dir):
    good = _parsed(spark, sf_dir).where(F.col("parse_error").isNull())
    return TL.timeline_entries(good).select(
        "slug", F.col("position").cast("long").alias("position"), "date", "source_url", "content", "agent"
    )


@register
def timeline_stats(spark, sf_dir):
    return TL.timeline_stats(fx.texts(spark, sf_dir))


@register
def extract_wikilinks(spark, sf_dir):
    good = _parsed(spark, sf_dir).where(F.col("parse_error").isNull())
    return unique_links(page_links(good))


def _doubled(spark, sf_dir):
    """Notes of which every English one holds its link twice, the second time with a label.

    Only backticks fence links off; a link between tildes counts.
    """
    target = F.concat(F.lit("[[cites::"), F.col("source"), F.lit("/x"))
    again = F.when(F.col("lang") == "en", F.concat(F.lit(" "), target, F.lit("|again]]"))).otherwise(F.lit(""))
    text = F.concat(F.lit("---\ntitle: T\n---\n~~~\n[[decoy]]\n~~~\n"), target, F.lit("]]"), again, F.lit(" [[plain/x]]\n"))
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("wiki/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("raw_content"))


@register
def repeated_links(spark, sf_dir):
    """The first of repeated links counts, or with ``reject`` the page keeps none; as result text shows them."""
    as_of = F.timestamp_seconds(F.lit(fx.SYNC_TIME))
    none = lambda schema: spark.createDataFrame([], schema)
    notes = written(_doubled(spark, sf_dir), "notes")
    out = None
    for mode in ("first", "reject"):
        done = Y.sync(none(PAGES), none(LINKS), notes, as_of, on_duplicate=mode)
        shown = G.link_view(done.links).select("source_slug", "target_slug", "link_type", F.lit(mode).alias("mode"))
        told = done.errors.select(F.col("path").alias("source_slug"), F.col("message").alias("target_slug"), F.col("stage").alias("link_type"), F.lit(mode).alias("mode"))
        out = shown.unionByName(told) if out is None else out.unionByName(shown).unionByName(told)
    return out


@register
def notes_append(spark, sf_dir):
    """Several writes to one note count in their order; what changes nothing is reported."""
    turn = F.element_at(F.split("path", "[/.]"), -2)
    notes = fx.raw_notes(spark, sf_dir).withColumn("turn", turn.cast("int"))
    notes = written(notes.withColumn("raw_content", F.when(F.col("turn") != 5, F.col("raw_content"))), "notes")
    puts = notes.where("turn < 2").select(
        "path", F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(v).alias("raw_content")) for k, v in ((3, "a"), (2, "b"), (1, None))])).alias("p")
    ).select("path", "p.*")
    appends = notes.select(
        "path", "turn", F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(v).alias("content")) for k, v in ((2, "second"), (1, "first"), (3, None))])).alias("a")
    ).select(F.when(F.col("turn") == 3, F.concat(F.lit("lost/"), "path")).otherwise(F.col("path")).alias("path"), "a.*")
    stored = written(N.put_notes(notes.select("path", "raw_content"), puts), "stored")
    rows = N.append_notes(stored, appends).select("path", X.content_hash(F.col("raw_content")).alias("value"))
    return rows.unionByName(N.write_errors(stored, puts, appends).select("path", F.col("message").alias("value")))


@register
def notes_store(spark, sf_dir):
    """Raw notes after a put, an append to every second of them and to some that don't exist, and a delete."""
    notes = written(fx.raw_notes(spark, sf_dir), "notes")
    put = notes.where("path like '%/0.md'").select("path", F.lit("replaced").alias("raw_content"))
    new = notes.where("path like '%/1.md'").select(F.concat("path", F.lit(".md")).alias("path"), F.lit("new").alias("raw_content"))
    stored = N.put_notes(notes, put.unionByName(new))
    appends = notes.where("path like '%/2.md'").select("path", F.lit("+").alias("content"))
    lost = appends.withColumn("path", F.concat(F.lit("lost/"), "path"))
    both = appends.unionByName(lost)
    kept = N.delete_notes(N.append_notes(stored, both), notes.where("path like '%/3.md'"))
    rows = kept.select("path", X.content_hash(F.col("raw_content")).alias("value"))
    return rows.unionByName(N.missing_appends(stored, both).select("path", F.col("message").alias("value")))


@register
def content_hash(spark, sf_dir):
    return fx.notes(spark, sf_dir).select("path", X.content_hash(F.col("raw_content")).alias("content_hash"))


def _index(spark, sf_dir):
    """(pages, links) tables as the old snapshot left them."""
    as_of = F.timestamp_seconds(F.lit(fx.CREATED_BASE))
    root = scratch_path(spark, "index")
    pages, _, _ = Y.reindex(fx.old_snapshot(spark, sf_dir), as_of)
    write_version(pages, f"{root}/pages", 0, **TEXT_CODEC)
    pages = read_version(spark, f"{root}/pages")
    write_version(unique_links(page_links(pages)), f"{root}/links", 0)
    return pages, read_version(spark, f"{root}/links")


@register
def sync_classify(spark, sf_dir):
    pages, _ = _index(spark, sf_dir)
    return Y.classify(pages, fx.new_snapshot(spark, sf_dir)).select("slug", "status")


def _synced(spark, sf_dir, stored=None):
    pages, links = stored or _index(spark, sf_dir)
    notes = written(fx.new_snapshot(spark, sf_dir), "notes", **TEXT_CODEC)
    return Y.sync(pages, links, notes, F.timestamp_seconds(F.lit(fx.SYNC_TIME)))


@register
def sync_pages(spark, sf_dir):
    return _synced(spark, sf_dir).pages.select(
        "slug",
        "title",
        "content_hash",
        F.unix_seconds("created_at").alias("created"),
        F.unix_seconds("updated_at").alias("updated"),
    )


@register
def sync_links(spark, sf_dir):
    return _synced(spark, sf_dir).links


@register
def sync_counts(spark, sf_dir):
    return _synced(spark, sf_dir).counts


@register
def sync_errors(spark, sf_dir):
    return _synced(spark, sf_dir).errors


def _small_index(spark, sf_dir, slug):
    """What a diff needs of stored pages: one per document."""
    return fx.table(spark, sf_dir, "documents").select(
        slug.alias("slug"), X.content_hash(F.col("text")).alias("content_hash"), F.timestamp_seconds(F.lit(fx.CREATED_BASE)).alias("created_at")
    )


@register
def files_sync(spark, sf_dir):
    """Notes as files, some with names that begin with ``_``; then some are changed, renamed and removed."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    number = F.col("doc_id").cast("string")
    name = F.concat(F.when(F.col("lang") == "en", F.lit("_")).otherwise(F.lit("n")), number, F.lit(".md"))
    raw = F.concat(F.lit("---\npage_type: Concept\ntitle: T"), number, F.lit("\n---\nbody\n"))
    path = F.concat(F.lit("wiki/"), F.coalesce("source", F.lit("none")), F.lit("/"), name)
    first = docs.select("lang", number.alias("id"), path.alias("path"), raw.alias("raw_content"))
    root = scratch_path(spark, "vault")
    empty = spark.createDataFrame([], FI.LISTING)
    no_pages, no_links = spark.createDataFrame([], PAGES), spark.createDataFrame([], LINKS)
    FI.write_files(first, root)
    _, pages, links, listing = FS.sync_files(no_pages, no_links, root, empty, F.timestamp_seconds(F.lit(fx.SYNC_TIME)))
    pages, links = written(pages, "pages"), written(links, "links")
    renamed = first.where("lang = 'fr'").select(F.concat(F.lit("wiki/_moved/"), F.col("id"), F.lit(".md")).alias("path"), "raw_content")
    changed = first.where("id like '%7' and lang <> 'de'").select("path", F.concat("raw_content", F.lit("more\n")).alias("raw_content"))
    FI.write_files(renamed.unionByName(changed), root)
    FI.delete_files(first.where("lang in ('de', 'fr')").select("path"), root)
    _, pages, _, _ = FS.sync_files(pages, links, root, listing, F.timestamp_seconds(F.lit(fx.SYNC_TIME + 60)))
    return pages.select("slug", "title", F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated"))


@register
def sync_deep_paths(spark, sf_dir):
    """One source lies deeper than a walk goes: it is reported and kept; another is gone."""
    deep = F.when(F.col("source") == "src3", F.lit("wiki/a/b/c/d/e/f/g/h/i/j/k/")).otherwise(F.lit("wiki/"))
    slug = F.concat(deep, F.col("doc_id").cast("string"))
    listed = fx.table(spark, sf_dir, "documents").where("source <> 'src7'")
    notes = listed.select(X.slug_to_path(slug).alias("path"), F.col("text").alias("raw_content"))
    status = written(Y.classify(_small_index(spark, sf_dir, slug), notes), "status")
    errors = Y.unlisted(status, notes, "wiki", True, 10, None)
    return status.select("slug", "status").unionByName(errors.select(F.col("message").alias("slug"), F.col("stage").alias("status")))


@register
def sync_duplicates(spark, sf_dir):
    """French notes are listed under two paths of one slug; the ``.md`` one counts, the other is reported."""
    slug = F.concat(F.lit("wiki/"), F.col("doc_id").cast("string"))
    docs = fx.table(spark, sf_dir, "documents")
    paths = F.when(F.col("lang") == "fr", F.array(slug, F.concat(slug, F.lit(".md")))).otherwise(F.array(F.concat(slug, F.lit(".md"))))
    notes = docs.select(F.explode(paths).alias("path"), "text")
    notes = notes.select("path", F.when(F.col("path").endswith(".md"), F.col("text")).otherwise(F.lit("other")).alias("raw_content"))
    status = written(Y.classify(_small_index(spark, sf_dir, slug), notes, markdown_only=False), "status")
    errors = Y.unlisted(status, notes, "wiki", False, 10, None)
    return status.select("slug", "path", "status").unionByName(
        errors.select(F.col("message").alias("slug"), "path", F.col("stage").alias("status"))
    )


@register
def envelope_sync(spark, sf_dir):
    """Listings in pages of 100, one of them missing: nothing below its folder is removed."""
    responses = written(fx.listings(spark, sf_dir), "responses")
    notes, _ = V.decode_envelopes(responses)
    index = _small_index(spark, sf_dir, fx.text_slug(F.col("doc_id")))
    stale = index.withColumn("slug", F.concat("slug", F.lit("-old")))
    status = Y.classify(index.unionByName(stale), notes, incomplete=V.incomplete_folders(responses))
    return status.select("slug", "status")


@register
def envelope_listings(spark, sf_dir):
    return V.listing_status(fx.listings(spark, sf_dir))


@register
def reindex(spark, sf_dir):
    pages, _, _ = Y.reindex(fx.new_snapshot(spark, sf_dir), F.timestamp_seconds(F.lit(fx.SYNC_TIME)))
    return pages.select("slug", "title", "page_type", "content_hash", F.unix_seconds("created_at").alias("created"))


@register
def reindex_errors(spark, sf_dir):
    """Every note of a listing with deep, repeated, unread and broken notes, as a page or an error of a rebuild."""
    docs = fx.table(spark, sf_dir, "documents")
    deep = F.when(F.col("source") == "src1", F.lit("wiki/a/b/c/d/e/f/g/h/i/j/k/")).otherwise(F.lit("wiki/"))
    raw = F.concat(F.lit("---\npage_type: Concept\ntitle: T"), F.col("doc_id").cast("string"), F.lit("\n---\nbody\n"))
    raw = F.when(F.col("source") == "src3", F.lit(None)).when(F.col("lang") == "de", F.lit("no frontmatter")).otherwise(raw)
    once = docs.select(F.concat(deep, F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), raw.alias("raw_content"), F.lit(1).alias("seq"))
    unread = once.where(F.col("path").endswith("7.md")).withColumns({"raw_content": F.lit(None).cast("string"), "seq": F.lit(2)})
    again = once.where(F.col("path").endswith("8.md"))
    notes = written(once.unionByName(unread).unionByName(again), "notes")
    pages, _, errors = Y.reindex(notes, F.timestamp_seconds(F.lit(fx.SYNC_TIME)))
    shown = pages.select("slug", F.lit("page").alias("stage"), F.col("title").alias("message"))
    return errors.select(F.col("path").alias("slug"), "stage", "message").unionByName(shown)


@register
def upsert_pages(spark, sf_dir):
    pages = fx.rendered_pages(spark, sf_dir)
    later = pages.where("lang = 'fr'").withColumns(
        {
            "title": F.upper("slug"),
            "created_at": F.timestamp_seconds(F.lit(fx.SYNC_TIME)),
            "updated_at": F.timestamp_seconds(F.lit(fx.SYNC_TIME)),
        }
    )
    return Y.upsert_pages(pages, later).select(
        "slug", "title", F.unix_seconds("created_at").alias("created"), F.unix_seconds("updated_at").alias("updated")
    )


@register
def delete_cascade(spark, sf_dir):
    gone = fx.pages(spark, sf_dir).where("page_type = 'Query'").select("slug")
    notes = fx.notes(spark, sf_dir)
    _, pages, links = Y.delete_pages(notes, fx.pages(spark, sf_dir), fx.links(spark, sf_dir), gone)
    kept = pages.select("slug", F.lit("page").alias("kind"))
    return kept.unionByName(links.select(F.concat_ws(" ", "source_slug", "link_type", "target_slug").alias("slug"), F.lit("link").alias("kind")))


@register
def slug_cleanup(spark, sf_dir):
    ending = F.when(F.col("lang") == "en", F.lit(".md")).when(F.col("lang") == "fr", F.lit(".MD")).otherwise(F.lit(""))
    pages = fx.pages(spark, sf_dir).withColumn("slug", F.concat("slug", ending))
    links = fx.links(spark, sf_dir).withColumn("target_slug", F.concat("target_slug", F.lit(".md")))
    tidy, tidy_links = Y.clean_slugs(pages, links)
    kept = tidy.select("slug", F.lit("page").alias("kind"))
    return kept.unionByName(
        tidy_links.select(F.concat_ws(" ", "source_slug", "link_type", "target_slug").alias("slug"), F.lit("link").alias("kind"))
    )


def _edited(spark, sf_dir):
    pages = fx.note_pages(spark, sf_dir)
    return E.apply_edits(pages, fx.edits(spark, sf_dir), F.timestamp_seconds(F.lit(fx.SYNC_TIME)))


def _edited_view(df):
    return df.select(
        "slug",
        "title",
        F.array_join("tags", "|").alias("tags"),
        "compiled_truth",
        "timeline_text",
        "content_hash",
        F.unix_seconds("created_at").alias("created"),
    )


@register
def edits_apply(spark, sf_dir):
    return _edited_view(_edited(spark, sf_dir).upserts)


@register
def edits_results(spark, sf_dir):
    return _edited(spark, sf_dir).results


@register
def edits_validation(spark, sf_dir):
    """Edits of raw notes and of new pages, most of them refused, by their turn."""
    kind = F.col("turn") % 7
    raw = kind.isin(0, 2, 4)
    name = F.concat_ws("-", "conv_id", "turn")
    edits = fx.table(spark, sf_dir, "conversations").select(
        F.concat(F.when(raw, F.lit("raw/")).otherwise(F.lit("wiki/n")), name).alias("slug"),
        F.col("turn").alias("seq"),
        F.col("text").alias("body"),
        F.when(kind.isin(2, 3), F.lit("{}"))
        .when(kind == 5, F.lit('{"title":"T","page_type":"Foo"}'))
        .when(kind == 6, F.lit('{"title":""}'))
        .alias("frontmatter"),
        F.when(~kind.isin(0, 2), F.lit("done")).alias("timeline_content"),
        F.lit(None).cast("string").alias("timeline_agent"),
        F.lit(None).cast("string").alias("etag"),
        F.lit("2025-01-01").alias("as_of_date"),
    )
    done = E.apply_edits(spark.createDataFrame([], PAGES), edits, F.timestamp_seconds(F.lit(fx.SYNC_TIME)))
    return done.results.select("slug", "seq", "status", "message", "content_hash", "indexed")


@register
def envelope_decode(spark, sf_dir):
    notes, _ = V.decode_envelopes(fx.envelopes(spark, sf_dir))
    return notes


@register
def envelope_errors(spark, sf_dir):
    _, errors = V.decode_envelopes(fx.envelopes(spark, sf_dir))
    return errors.groupBy("stage", "message").agg(F.count("*").alias("n_responses"))


@register
def nearest_vectors(spark, sf_dir):
    near = similarity.nearest(fx.table(spark, sf_dir, "embeddings"), 0, 20)
    return near.withColumn("similarity", F.round("similarity", 6))


def _streamed(spark, sf_dir, together=False):
    snapshots = [fx.old_snapshot(spark, sf_dir), fx.new_snapshot(spark, sf_dir)]
    return stream_sync.replay(spark, snapshots, F.timestamp_seconds(F.lit(fx.SYNC_TIME)), together)


@register
def stream_sync_pages(spark, sf_dir):
    """Both snapshots arrive one after the other; nothing is removed by a stream."""
    return _streamed(spark, sf_dir)[0].select("slug", "title", "content_hash")


@register
def stream_sync_compacted(spark, sf_dir):
    """The same, with a further arrival of what is known, and the log compacted after each restart of the stream."""
    snapshots = [fx.old_snapshot(spark, sf_dir), fx.new_snapshot(spark, sf_dir), fx.new_snapshot(spark, sf_dir)]
    pages, _, _ = stream_sync.replay(spark, snapshots, F.timestamp_seconds(F.lit(fx.SYNC_TIME)), compacted=True)
    return pages.select("slug", "title", "content_hash")


@register
def stream_sync_errors(spark, sf_dir):
    """What the same stream could not fetch or parse, once per arrival."""
    return _streamed(spark, sf_dir)[2]


@register
def stream_sync_one_batch(spark, sf_dir):
    """Both snapshots arrive in one batch: one row per page, of the later arrival that could be fetched."""
    return _streamed(spark, sf_dir, together=True)[0].select("slug", "title", "content_hash")


@register
def stream_edits_pages(spark, sf_dir):
    """The edits of ``edits_apply``, arriving in two parts."""
    pages, edits = fx.note_pages(spark, sf_dir), fx.edits(spark, sf_dir)
    parts = [edits.where("seq < 2"), edits.where("seq >= 2")]
    state = stream_edits.replay(spark, pages, parts, F.timestamp_seconds(F.lit(fx.SYNC_TIME)))
    return _edited_view(state)
