"""A note collection derived from the provided tables, row by row: the whole tables, nothing sampled.

Ids only shape the derived values (which page has a blank title, which link is broken), so that every
quality check and parse path meets data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.functions.text import content_hash, slug_to_path, trim_long, trim_ws
from notelattice.operators.parse import render_notes, unique_links
from notelattice.schema import PAGE_TYPES, PAGES, WHITESPACE
from notelattice.sources.envelopes import encode_envelopes

UPDATED_BASE = 1704067200
CREATED_BASE = 1672531200
SYNC_TIME = 1735689600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of an input with fewer partitions than cores over all cores; a large input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def text_slug(doc_id: Column) -> Column:
    """Slug of a document; some are invalid on purpose."""
    bad = F.when(doc_id % 29 == 0, F.lit("!")).otherwise(F.lit(""))
    return F.concat(F.lit("wiki/"), (doc_id % 20).cast("string"), F.lit("/"), doc_id.cast("string"), bad)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What search needs of the pages: no tags, so no join."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    docs = docs.withColumn("_line", F.substring_index("text", "\n", 1))
    doc_id = F.col("doc_id")
    nothing = F.array().cast("array<string>")
    two = lambda n: F.lpad((n).cast("string"), 2, "0")
    entry = lambda i: F.struct(
        F.concat(F.lit("2024-01-0"), (i + 1).cast("string")).alias("date"),
        F.when(i == 0, F.concat(F.lit("https://example.org/"), "source")).alias("source_url"),
        F.concat("source", F.lit("-note "), i.cast("string"), F.lit(" of "), "lang").alias("content"),
        F.when(i == 1, F.col("lang")).alias("agent"),
    )
    columns = {
        "slug": text_slug(doc_id),
        "title": F.when(doc_id % 17 == 0, F.lit(" ")).otherwise(trim_long(F.col("_line"))),
        "page_type": F.element_at(F.array(*[F.lit(p) for p in PAGE_TYPES]), (doc_id % 6 + 1).cast("int")),
        "sources": F.when(doc_id % 5 == 0, nothing).otherwise(
            F.array(F.concat(F.lit("https://example.org/"), "source", F.lit("/"), doc_id.cast("string")))
        ),
        "date": F.when(
            doc_id % 3 != 0, F.concat(F.lit("2024-"), two(doc_id % 12 + 1), F.lit("-"), two(doc_id % 28 + 1))
        ),
        "visibility": F.when(doc_id % 10 == 0, F.lit("private")).otherwise(F.lit("shared")),
        "created_by": F.when(doc_id % 4 != 0, F.col("lang")),
        "compiled_truth": F.when(doc_id % 31 == 0, F.lit("")).otherwise(trim_long(F.col("text"))),
        "timeline": F.transform(
            F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < doc_id % 4), entry
        ),
    }
    d = docs.withColumns(columns)
    return d.withColumns(
        {
            "timeline_text": F.array_join(F.transform("timeline", lambda e: e["content"]), " "),
            "vault": F.lit(""),
            "created_at": F.timestamp_seconds(F.lit(CREATED_BASE) + doc_id * 60),
            "updated_at": F.timestamp_seconds(F.lit(UPDATED_BASE) + doc_id * 3600),
        }
    ).drop("text", "_line")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with tags, not yet rendered to note text."""
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    tags = F.array_compact(F.array("lang", "source", F.when(F.col("quality") == 1, F.lit("quality"))))
    tags = F.when(F.col("doc_id") % 13 == 0, F.array().cast("array<string>")).otherwise(tags)
    return texts(spark, sf_dir).join(quality, "doc_id", "left").withColumn("tags", tags).drop("quality")


def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(pages(spark, sf_dir))


def _rendered(p: DataFrame) -> DataFrame:
    p = render_notes(p).withColumn("content_hash", content_hash(F.col("raw_content")))
    return p.select("doc_id", "lang", "source", *PAGES.fieldNames())


def _targets(spark: SparkSession, sf_dir: str) -> tuple[Column, Column, Column]:
    """Two link targets per document, some beyond the last document, and the type of both links."""
    n = table(spark, sf_dir, "documents").agg(F.count("*")).scalar()
    doc_id = F.col("doc_id")
    first = (doc_id * 7 + 1) % (n + F.floor(n / 10))
    second = (doc_id * 13 + 5) % F.floor(n / 2)
    kind = F.element_at(
        F.array(F.lit("plain"), F.lit("cites"), F.lit("references")), (doc_id % 3 + 1).cast("int")
    )
    return first, second, kind


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between documents, unique by (source, target, type)."""
    first, second, kind = _targets(spark, sf_dir)
    both = F.array(
        F.struct(F.lit(0).alias("position"), first.alias("to")), F.struct(F.lit(1).alias("position"), second.alias("to"))
    )
    found = (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.explode(both).alias("l"), kind.alias("link_type"))
        .where(F.col("l.to") != F.col("doc_id"))
        .select(
            text_slug(F.col("doc_id")).alias("source_slug"),
            text_slug(F.col("l.to")).alias("target_slug"),
            "link_type",
            F.when(F.col("l.position") == 1, F.lit("second")).alias("context_snippet"),
            F.col("l.position").alias("position"),
        )
    )
    return unique_links(found)


def note_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose text holds its links, plus a code block with a separator and a link that must not count."""
    first, second, kind = _targets(spark, sf_dir)
    typed = F.when(kind == "plain", F.lit("")).otherwise(F.concat(kind, F.lit("::")))
    links_text = F.concat(
        F.lit("\n\nSee [["),
        typed,
        text_slug(first),
        F.lit("]] and [["),
        typed,
        text_slug(second),
        F.lit(".md|second]].\n\n```\n[[decoy]]\n---\n```\n\nUse `[[code]]` too."),
    )
    p = pages(spark, sf_dir)
    p = p.withColumn("compiled_truth", F.ltrim(F.concat("compiled_truth", links_text), F.lit(WHITESPACE)))  # ends with a full stop
    return _rendered(p)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return note_pages(spark, sf_dir).select(slug_to_path(F.col("slug")).alias("path"), "raw_content")


def raw_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as notes of the raw space."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("raw/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".md")).alias(
            "path"
        ),
        F.col("text").alias("raw_content"),
    )


def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed graph of the order tables: hubs at nations and regions, repeated (order, part) edges combined."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))

    def edges(source: DataFrame, a: Column, b: Column, kind: str) -> DataFrame:
        return source.select(
            a.alias("source_slug"),
            b.alias("target_slug"),
            F.lit(kind).alias("link_type"),
            F.lit(None).cast("string").alias("context_snippet"),
        )

    t = lambda n: table(spark, sf_dir, n)
    parts = [
        edges(t("orders"), name("order", "o_orderkey"), name("customer", "o_custkey"), "placed_by"),
        edges(t("customer"), name("customer", "c_custkey"), name("nation", "c_nationkey"), "in"),
        edges(t("nation"), name("nation", "n_nationkey"), name("region", "n_regionkey"), "in"),
        edges(t("supplier"), name("supplier", "s_suppkey"), name("nation", "s_nationkey"), "in"),
        edges(t("lineitem").select("l_orderkey", "l_partkey").distinct(), name("order", "l_orderkey"), name("part", "l_partkey"), "contains"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def graph_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and types of the same graph."""
    keys = {
        "order": ("orders", "o_orderkey"),
        "customer": ("customer", "c_custkey"),
        "nation": ("nation", "n_nationkey"),
        "region": ("region", "r_regionkey"),
        "supplier": ("supplier", "s_suppkey"),
        "part": ("part", "p_partkey"),
    }
    out = None
    for kind, (name, key) in keys.items():
        rows = table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("slug"), F.lit(kind).alias("page_type")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def old_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as they were: German pages not yet written, those of two sources still with other text."""
    altered = F.col("source").isin("src3", "src4")
    p = note_pages(spark, sf_dir).where("lang <> 'de'")
    p = p.withColumn(
        "compiled_truth",
        F.when(altered, F.concat(F.lit("Draft. "), F.col("compiled_truth"))).otherwise(F.col("compiled_truth")),
    )
    return render_notes(p).select(slug_to_path(F.col("slug")).alias("path"), "raw_content")


def new_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as they are: one source is gone, another cannot be fetched."""
    return (
        note_pages(spark, sf_dir)
        .where("source <> 'src7'")
        .select(
            slug_to_path(F.col("slug")).alias("path"),
            F.when(F.col("source") != "src5", F.col("raw_content")).alias("raw_content"),
        )
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed responses: listings of at most 100 documents each, and one failed response per removed document."""
    docs = table(spark, sf_dir, "documents")
    item = F.struct(slug_to_path(text_slug(F.col("doc_id"))).alias("path"), F.col("text").alias("content"))
    listings = docs.groupBy(F.floor(F.col("doc_id") / 100).alias("page")).agg(
        F.lit(1).alias("code"), F.lit("Success").alias("message"), F.collect_list(item).alias("notes")
    )
    no_notes = F.array().cast(listings.schema["notes"].dataType)
    missing = docs.where("source = 'src9'").select(
        F.lit(430).alias("code"), F.lit(None).cast("string").alias("message"), no_notes.alias("notes")
    )
    failed = docs.where("source = 'src8'").select(
        F.lit(305).alias("code"), F.concat(F.lit("denied "), "lang").alias("message"), no_notes.alias("notes")
    )
    rows = listings.drop("page").unionByName(missing).unionByName(failed)
    return encode_envelopes(rows)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed listings of the folders of documents, at most 100 notes each; the first of folder 3 never came."""
    docs = table(spark, sf_dir, "documents").withColumn("path", slug_to_path(text_slug(F.col("doc_id"))))
    docs = docs.withColumn("folder", F.concat(F.lit("wiki/"), (F.col("doc_id") % 20).cast("string")))
    totals = docs.groupBy("folder").agg(F.count("*").alias("total"))
    pages = docs.groupBy("folder", F.floor(F.col("doc_id") / 2000).alias("page")).agg(
        F.collect_list(F.struct("path", F.col("text").alias("content"))).alias("notes")
    )
    rows = pages.join(totals, "folder").where("folder <> 'wiki/3' or page > 0")
    # A folder of which no page came is known from the request that failed.
    lost = totals.where("folder = 'wiki/3'").withColumn("notes", F.array().cast(pages.schema["notes"].dataType))
    rows = rows.withColumn("code", F.lit(1)).unionByName(lost.withColumn("code", F.lit(500)), allowMissingColumns=True)
    return encode_envelopes(rows.withColumn("message", F.lit(None).cast("string")))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit commands from conversations: one per turn.

    Long conversations (five turns or more) edit the document page of the same number, shorter ones make a
    new page. The first and the third edit of a document page are guarded by its stored hash, so the third
    one comes too late.
    """
    turns = table(spark, sf_dir, "conversations")
    length = turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    stored = note_pages(spark, sf_dir).select("slug", "content_hash")
    long = F.col("last_turn") >= 4
    slug = F.when(long, text_slug(F.col("conv_id"))).otherwise(
        F.concat(F.lit("talk/"), F.col("conv_id").cast("string"))
    )
    first_line = trim_ws(F.substring_index("text", "\n", 1))
    update = F.to_json(F.struct(first_line.alias("title"), F.array("role", F.lit("talk")).alias("tags")))
    return (
        turns.join(length, "conv_id")
        .withColumn("slug", slug)
        .join(stored, "slug", "left")
        .select(
            "slug",
            F.col("turn").alias("seq"),
            F.col("text").alias("body"),
            F.when(F.col("turn") == 0, update).alias("frontmatter"),
            F.concat("role", F.lit(" turn "), F.col("turn").cast("string")).alias("timeline_content"),
            F.when(F.col("turn") != 1, F.col("role")).alias("timeline_agent"),
            F.when(F.col("turn").isin(0, 2), F.col("content_hash")).alias("etag"),
            F.lit("2025-01-01").alias("as_of_date"),
        )
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark text: all its words of three characters and more."""
    words = F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\s]", " "), r"\s+")
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.filter(F.array_distinct(words), lambda w: F.char_length(w) >= 3).alias("terms"),
    )
