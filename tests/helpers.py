"""Small builders for fixtures written by hand."""

from pyspark.sql import functions as F

from notelattice.functions.body import timeline_text
from notelattice.functions.text import normalize_slug
from notelattice.operators.parse import parse_notes, render_notes
from notelattice.schema import LINKS, PAGES



def at(seconds):
    return F.timestamp_seconds(F.lit(seconds))


def note(title="T", body="Body.", page_type="Concept", extra=""):
    return f"---\ntitle: {title}\npage_type: {page_type}\ntags: []\nsources: []\n{extra}---\n{body}\n"


def notes_df(spark, rows):
    return spark.createDataFrame(list(rows.items()), "path string, raw_content string")


def parsed(spark, raws):
    """Parsed rows by slug for {slug: raw}."""
    df = spark.createDataFrame(list(raws.items()), "slug string, raw_content string")
    return {r.slug: r for r in parse_notes(df).collect()}


def pages_df(spark, rows):
    """Pages from dicts; what is missing takes defaults."""
    blank = {
        "title": "", "page_type": "Concept", "tags": [], "sources": [], "date": None, "visibility": "shared",
        "created_by": None, "compiled_truth": "", "timeline": [], "timeline_text": "", "content_hash": "",
        "raw_content": "", "vault": "", "created_at": None, "updated_at": None,
    }
    data = [tuple((blank | row)[f] for f in PAGES.fieldNames()) for row in rows]
    df = spark.createDataFrame(data, PAGES)
    return df.withColumn("timeline_text", timeline_text(F.col("timeline")))


def indexed(spark, rows):
    """Pages as parsed from notes {path: raw}, stored at the epoch."""
    df = notes_df(spark, rows).withColumn("slug", normalize_slug(F.col("path")))
    out = parse_notes(df).withColumns({"created_at": at(0), "updated_at": at(0)})
    return out.select(*PAGES.fieldNames())


def links_df(spark, rows):
    return spark.createDataFrame([tuple(r) + (None,) * (4 - len(r)) for r in rows], LINKS)


def rendered(pages):
    return render_notes(pages)
