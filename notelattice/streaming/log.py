"""Current state of append-only page and link logs: the newest version of every page wins.

``compact`` writes what versions up to a bound add up to as a snapshot. Readers take the newest snapshot below their own
bound and the versions behind it, so what was superseded is neither listed nor read. Rows keep the version that wrote
them, so pages find their links in a snapshot as in the log. The snapshot of the pages is written last and is what
makes it valid. The newest version is never part of it, for its batch may run once more. Nothing is removed by it:
readers opened before still answer, and a stream may run meanwhile. ``vacuum`` removes what a snapshot replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelattice.operators.skew import if_small
from notelattice.schema import LINKS, PAGES
from notelattice.session import TEXT_CODEC, written
from notelattice.sources.tables import finished_versions, read_log, write_version

SCHEMAS = {"pages": PAGES, "links": LINKS}


def snapshot_version(spark: SparkSession, root: str, below: int | None = None) -> int | None:
    """The newest snapshot that holds no version from ``below`` on."""
    found = finished_versions(spark, f"{root}/snapshots/pages")
    return max((v for v in found if below is None or v < below), default=None)


def _log(spark: SparkSession, root: str, name: str, below: int | None, since: int | None) -> DataFrame:
    """Rows of snapshot ``since`` and of the versions behind it, each with the version that wrote it."""
    schema = T.StructType([*SCHEMAS[name].fields, T.StructField("version", T.LongType())])
    parts = []
    if since is not None:
        parts.append(spark.read.schema(schema).parquet(f"{root}/snapshots/{name}/version={since}"))
    versions = [
        v
        for v in finished_versions(spark, f"{root}/{name}")
        if (below is None or v < below) and (since is None or v > since)
    ]
    if versions:
        parts.append(read_log(spark, f"{root}/{name}", below, since).select(*schema.fieldNames()))
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def current_hashes(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    """``(slug, content_hash, created_at)`` of the newest row of every slug: three columns of the log, no text."""
    log = _log(spark, root, "pages", below, snapshot_version(spark, root, below))
    newest = log.groupBy("slug").agg(F.max_by(F.struct("content_hash", "created_at"), "version").alias("_row"))
    return newest.select("slug", "_row.*")


def _current(spark: SparkSession, root: str, below: int | None) -> tuple[DataFrame, DataFrame]:
    """Pages and links that count, with their versions."""
    since = snapshot_version(spark, root, below)
    pages = _log(spark, root, "pages", below, since)
    newest = pages.groupBy("slug").agg(F.max("version").alias("version"))
    links = _log(spark, root, "links", below, since)
    sources = newest.withColumnRenamed("slug", "source_slug")
    return (
        pages.join(newest, ["slug", "version"], "left_semi"),
        links.join(sources, ["source_slug", "version"], "left_semi"),
    )


def _kept_pages(spark: SparkSession, root: str, below: int) -> DataFrame:
    """The pages of ``_current``, for whole rows: superseded ones are taken out, so while these are few the text of the
    others stays where it is. A version alone has one row per slug, so nothing of it was superseded."""
    since = snapshot_version(spark, root, below)
    pages = _log(spark, root, "pages", below, since)
    behind = [v for v in finished_versions(spark, f"{root}/pages") if v < below and (since is None or v > since)]
    if len(behind) + (since is not None) == 1:
        return pages
    versions = pages.groupBy("slug").agg(F.sort_array(F.collect_set("version")).alias("_all")).where(F.size("_all") > 1)
    old = versions.select("slug", F.explode(F.slice("_all", F.lit(1), F.size("_all") - 1)).alias("version"))
    return pages.join(if_small(written(old, "superseded")), ["slug", "version"], "left_anti")


def current_pages(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    """Newest row of every slug. Slugs and versions are aggregated; the text meets them in a semi join, which
    moves it if the table of slugs is too large to broadcast. Batches read ``current_hashes`` instead."""
    return _current(spark, root, below)[0].select(*PAGES.fieldNames())


def current_links(spark: SparkSession, root: str, below: int | None = None) -> DataFrame:
    """Links written with the newest version of their source page."""
    return _current(spark, root, below)[1].select(*LINKS.fieldNames())


def compact(spark: SparkSession, root: str) -> int | None:
    """Write a snapshot of all versions but the newest; its version, or None if there is nothing to gather."""
    finished = finished_versions(spark, f"{root}/pages")[:-1]
    if not finished or snapshot_version(spark, root) == finished[-1]:
        return snapshot_version(spark, root)
    _, links = _current(spark, root, finished[-1] + 1)
    write_version(links, f"{root}/snapshots/links", finished[-1])
    write_version(_kept_pages(spark, root, finished[-1] + 1), f"{root}/snapshots/pages", finished[-1], **TEXT_CODEC)
    return finished[-1]


def vacuum(spark: SparkSession, root: str) -> list[int]:
    """Remove the versions and snapshots that the newest snapshot replaces; the versions removed.

    For a time when nothing reads them any more. Errors and other logs stay.
    """
    since = snapshot_version(spark, root)
    if since is None:
        return []
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(root).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [v for v in finished_versions(spark, f"{root}/pages") if v <= since]
    for name in SCHEMAS:
        for v in gone:
            files.delete(folder(f"{root}/{name}/version={v}"), True)
        for v in finished_versions(spark, f"{root}/snapshots/{name}"):
            if v < since:
                files.delete(folder(f"{root}/snapshots/{name}/version={v}"), True)
    return gone
