"""Table schemas and the fixed values of the note format."""

from pyspark.sql import types as T

# Fixed values of the note format.
PAGE_TYPES = ["Entity", "Concept", "Source", "Query", "Synthesis", "Comparison"]
DEFAULT_PAGE_TYPE = "Entity"
DEFAULT_VISIBILITY = "shared"
FRONTMATTER_KEYS = ["title", "page_type", "tags", "sources", "date", "visibility", "created_by"]
MAX_SLUG_BYTES = 255
MAX_WALK_DEPTH = 10
DEFAULT_SEARCH_LIMIT = 10
MAX_SEARCH_LIMIT = 100
PREVIEW_CHARS = 200
BM25_K1 = 1.2
BM25_B = 0.75
MIN_IDF = 1e-6
SEARCH_COLUMNS = ["slug", "title", "compiled_truth", "timeline_text"]
SEARCH_WEIGHTS = (10.0, 5.0, 1.0, 1.0)
# Unicode White_Space.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

TIMELINE_ENTRY = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("agent", T.StringType()),
    ]
)

FRONTMATTER = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("page_type", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("date", T.StringType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("created_by", T.StringType()),
    ]
)

NOTES = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("raw_content", T.StringType())]
)

PAGES = T.StructType(
    [
        T.StructField("slug", T.StringType()),
        *FRONTMATTER.fields,
        T.StructField("compiled_truth", T.StringType()),
        T.StructField("timeline", T.ArrayType(TIMELINE_ENTRY)),
        T.StructField("timeline_text", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("raw_content", T.StringType()),
        T.StructField("vault", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

LINKS = T.StructType(
    [
        T.StructField("source_slug", T.StringType()),
        T.StructField("target_slug", T.StringType()),
        T.StructField("link_type", T.StringType()),
        T.StructField("context_snippet", T.StringType()),
    ]
)

EDITS = T.StructType(
    [
        T.StructField("slug", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("body", T.StringType()),
        T.StructField("frontmatter", T.StringType()),
        T.StructField("timeline_content", T.StringType()),
        T.StructField("timeline_agent", T.StringType()),
        T.StructField("etag", T.StringType()),
        T.StructField("as_of_date", T.StringType()),
    ]
)

ENVELOPE = T.StructType(
    [
        T.StructField("code", T.IntegerType()),
        T.StructField("status", T.BooleanType()),
        T.StructField("message", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "list",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("path", T.StringType()),
                                    T.StructField("content", T.StringType()),
                                ]
                            )
                        ),
                    ),
                    T.StructField("pager", T.StructType([T.StructField("totalRows", T.LongType())])),
                ]
            ),
        ),
    ]
)
