"""Notes as ``(path, raw_content)``: reading a folder of files, walking, writing, appending, deleting."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.functions.text import has_hidden_segment
from notelattice.operators.lookup import list_dir
from notelattice.schema import MAX_WALK_DEPTH
from notelattice.sources.files import list_files, read_files


def _relative_path(root: str) -> Column:
    """Path below ``root`` of the file a row came from."""
    base = urlparse(root).path.rstrip("/") + "/"
    # file_path is URI-encoded; a plus sign in a URI path stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substr(path, F.instr(path, base) + len(base))


#: What Spark's lister skips: empty files, files ``_x``, and folders ``_x`` but for ``_metadata...``; ``_x=y`` it takes.
PASSED_OVER = r"size = 0 or path rlike r'(^|/)_[^/=]*$' or path rlike r'(^|/)_(?!metadata|common_metadata)[^/=]*/'"


def read_notes(spark: SparkSession, root: str, markdown_only: bool = True, underscored: bool = True) -> DataFrame:
    """All notes below a folder, one row per file; names that start with a dot are hidden.

    Spark's lister also skips empty files and most names that start with ``_``; those are found and read through
    Arrow's file systems. ``underscored=False`` leaves them out, for stores that only Spark can open.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if markdown_only:
        reader = reader.option("pathGlobFilter", "*.md")
    seen = reader.text(root, wholetext=True).select(_relative_path(root).alias("path"), F.col("value").alias("raw_content"))
    if not underscored:
        return seen
    others = list_files(spark, root, markdown_only).where(PASSED_OVER)
    return seen.unionByName(read_files(spark, root, others))


def stream_notes(spark: SparkSession, root: str, markdown_only: bool = True) -> DataFrame:
    """A stream of files as they arrive, without names that start with ``_`` (``files.sync_files`` sees them)."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if markdown_only:
        reader = reader.option("pathGlobFilter", "*.md")
    return reader.text(root, wholetext=True).select(_relative_path(root).alias("path"), F.col("value").alias("raw_content"))


def _below(path: Column, directory: str) -> tuple[str, Column]:
    prefix = "" if directory in (".", "") else directory.rstrip("/") + "/"
    return prefix, F.substr(path, F.lit(len(prefix) + 1))


def too_deep(path: Column, directory: str = "wiki", max_depth: int = MAX_WALK_DEPTH) -> Column:
    """Whether a path lies below ``directory`` and more than ``max_depth`` folders down."""
    prefix, below = _below(path, directory)
    deep = F.size(F.split(below, "/")) - 1 > max_depth
    return path.startswith(prefix) & deep if prefix else deep


def walk(
    notes: DataFrame, directory: str = "wiki", markdown_only: bool = True, max_depth: int | None = MAX_WALK_DEPTH
) -> DataFrame:
    """Notes that a recursive walk of ``directory`` finds: not hidden, at most ``max_depth`` folders down (None: any).

    ``sync`` reports what the depth leaves out.
    """
    prefix, below = _below(F.col("path"), directory)
    found = notes.where(F.col("path").startswith(prefix)) if prefix else notes
    found = found.where(~has_hidden_segment(below))
    if max_depth is not None:
        found = found.where(~too_deep(F.col("path"), directory, max_depth))
    return found.where(F.col("path").endswith(".md")) if markdown_only else found


def get_note(notes: DataFrame, path: str) -> DataFrame:
    return notes.where(F.col("path") == path)


def list_folders(notes: DataFrame, directory: str = ".") -> DataFrame:
    return list_dir(notes, directory).where("kind = 'folder'").select("path")


def _in_order(rows: DataFrame, content: str) -> Column:
    """Order of the writes to one note: by ``seq`` if there is one, then by content, so that it never changes."""
    seq = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(0).cast("long")
    return F.struct(seq.alias("seq"), F.col(content).alias("content"))


def put_notes(notes: DataFrame, updates: DataFrame) -> DataFrame:
    """Write or overwrite notes by path. Of several ``updates(path, raw_content[, seq])`` the last one stays.

    An update without content changes nothing. ``write_errors`` tells of those.
    """
    some = updates.where(F.col("raw_content").isNotNull())
    new = some.groupBy("path").agg(F.max(_in_order(some, "raw_content"))["content"].alias("_new"))
    return notes.join(new, "path", "full_outer").select("path", F.coalesce("_new", "raw_content").alias("raw_content"))


def append_notes(notes: DataFrame, appends: DataFrame) -> DataFrame:
    """Append ``appends(path, content[, seq])`` to existing notes, those of one note in the order of ``seq``.

    The contents of a note become one row before they meet it, so it stays one row. ``write_errors`` tells which
    appends change nothing: without content, to a note that doesn't exist, or to one whose own content is missing.
    """
    some = appends.where(F.col("content").isNotNull())
    joined = some.groupBy("path").agg(F.sort_array(F.collect_list(_in_order(some, "content"))).alias("_all"))
    joined = joined.select("path", F.array_join("_all.content", "").alias("_all"))
    return notes.join(joined, "path", "left").select(
        "path", F.concat("raw_content", F.coalesce("_all", F.lit(""))).alias("raw_content")
    )


def _error(rows: DataFrame, stage: str, message: str) -> DataFrame:
    return rows.select("path", F.lit(stage).alias("stage"), F.concat(F.lit(f"{message}: "), F.col("path")).alias("message"))


def missing_appends(notes: DataFrame, appends: DataFrame) -> DataFrame:
    """Errors ``(path, stage, message)`` of appends to notes that don't exist."""
    lost = appends.select("path").distinct().join(notes.select("path"), "path", "left_anti")
    return _error(lost, "append", "note does not exist")


def write_errors(
    notes: DataFrame, puts: DataFrame | None = None, appends: DataFrame | None = None
) -> DataFrame:
    """Errors ``(path, stage, message)`` of puts and appends that change nothing; ``notes`` as the appends meet them."""
    errors = notes.sparkSession.createDataFrame([], "path string, stage string, message string")
    if puts is not None:
        errors = errors.unionByName(_error(puts.where(F.col("raw_content").isNull()), "put", "no content to write"))
    if appends is not None:
        unread = appends.select("path").distinct().join(notes.where(F.col("raw_content").isNull()).select("path"), "path", "left_semi")
        errors = (
            errors.unionByName(missing_appends(notes, appends))
            .unionByName(_error(appends.where(F.col("content").isNull()), "append", "no content to append"))
            .unionByName(_error(unread, "append", "note could not be read"))
        )
    return errors


def delete_notes(notes: DataFrame, paths: DataFrame) -> DataFrame:
    return notes.join(paths.select("path"), "path", "left_anti")
