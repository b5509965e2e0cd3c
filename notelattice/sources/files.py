"""Note files through Arrow's file systems: listing, reading, writing and removing, names that begin with ``_`` included.

Spark's own lister hides such names. Here every level of folders is one job, a folder's listing is one row of work, and
no file name passes the driver. A listing has ``(path, modified, size)``: the path below the root, milliseconds, bytes.
``changes`` compares two listings. A file that is rewritten within one millisecond to the same size is not seen as changed.

The functions of the tasks are closed over what they need, so workers don't have to import this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.session import qualified, written

LISTING = "path string, modified long, size long"
BATCH_CHARS = 1 << 20  # of texts that a task hands over at once; a longer one goes alone
MOST_FILES = 1024


def _store(spark: SparkSession, root: str) -> Callable:
    """Opens ``root`` where it is called: (Arrow file system, path of the root in it)."""
    uri = qualified(spark, root).rstrip("/")

    def opened():
        import re

        from pyarrow import fs

        if uri.startswith("file:"):
            return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))

    try:
        opened()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, NotImplementedError) as error:
        raise ValueError(f"Arrow has no file system for {uri}; only Spark's own reader can read it") from error
    return opened


def list_files(spark: SparkSession, root: str, markdown_only: bool = True) -> DataFrame:
    """``LISTING`` of all files below ``root`` that have no name beginning with a dot on their way."""
    opened = _store(spark, root)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = opened()
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                selector = fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True)
                found = [i for i in store.get_file_info(selector) if not i.base_name.startswith(".")]
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [f"{folder}/{i.base_name}".lstrip("/") for i in found],
                        "modified": pa.array([(i.mtime_ns or 0) // 1_000_000 for i in found], pa.int64()),
                        "size": pa.array([None if i.type == fs.FileType.Directory else i.size for i in found], pa.int64()),
                    }
                )

    tasks = spark.sparkContext.defaultParallelism
    folders = spark.range(1).select(F.lit("").alias("path"))
    listing = spark.createDataFrame([], LISTING)
    while True:
        found = written(folders.mapInArrow(level, LISTING), "listing")
        listing = listing.unionByName(found.where("size is not null"))
        below = found.where("size is null").select("path")
        if below.isEmpty():
            break
        # Folders differ in size: they are dealt anew, in more pieces than there are cores.
        folders = below.repartition(4 * tasks, "path")
    return listing.where(F.col("path").endswith(".md")) if markdown_only else listing


def read_files(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """``(path, raw_content)`` of listed files; null content where a file is gone by now or can't be read."""
    opened, limit, most = _store(spark, root), BATCH_CHARS, MOST_FILES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened()
        paths, texts, total = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with store.open_input_stream(f"{top}/{path}", compression=None) as file:
                        text = file.read().decode("utf-8", "replace")
                except OSError:
                    text = None
                paths.append(path)
                texts.append(text)
                total += len(text or "")
                if total >= limit or len(paths) >= most:
                    yield pa.RecordBatch.from_pydict({"path": paths, "raw_content": pa.array(texts, pa.string())})
                    paths, texts, total = [], [], 0
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "raw_content": pa.array(texts, pa.string())})

    # Paths are few bytes and their files are not: without a number, Spark would put them together into few tasks.
    paths = listing.select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return paths.mapInArrow(read, "path string, raw_content string")


def _each_file(spark: SparkSession, rows: DataFrame, root: str, act: Callable) -> DataFrame:
    """``path`` of every row, after ``act(file system, full path, content)``; repeating it changes nothing."""
    opened = _store(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened()
        for batch in batches:
            paths, contents = batch.column("path").to_pylist(), batch.column("raw_content").to_pylist()
            for path, content in zip(paths, contents, strict=True):
                act(store, f"{top}/{path}", content)
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    return written(rows.mapInArrow(run, "path string"), "files")


def write_files(notes: DataFrame, root: str) -> DataFrame:
    """Write ``notes(path, raw_content)``, one file each, paths unique; returns the paths. Rows without content are left out."""

    made: set[str] = set()  # a task's own, the latest folders it made

    def put(store, path: str, content: str) -> None:
        folder = path.rpartition("/")[0]
        if folder not in made:
            store.create_dir(folder, recursive=True)
            if len(made) >= 1024:
                made.clear()
            made.add(folder)
        with store.open_output_stream(path, compression=None) as out:
            out.write(content.encode())

    some = notes.where(F.col("raw_content").isNotNull()).select("path", "raw_content")
    return _each_file(notes.sparkSession, some, root, put)


def delete_files(paths: DataFrame, root: str) -> DataFrame:
    """Remove the files of ``paths(path)``; those that don't exist are left out of the work. Returns the paths."""

    def remove(store, path: str, content: None) -> None:
        from pyarrow import fs

        if store.get_file_info(path).type == fs.FileType.File:
            store.delete_file(path)

    rows = paths.select("path", F.lit(None).cast("string").alias("raw_content"))
    return _each_file(paths.sparkSession, rows, root, remove)


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, status)`` of new, changed and removed files between two listings."""
    old = before.select("path", F.struct("modified", "size").alias("_old"))
    new = now.select("path", F.struct("modified", "size").alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), F.lit("new"))
        .when(F.col("_new").isNull(), F.lit("removed"))
        .when(F.col("_old") != F.col("_new"), F.lit("changed"))
    )
    return old.join(new, "path", "full_outer").select("path", status.alias("status")).where("status is not null")
