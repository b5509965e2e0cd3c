"""Incremental sync of a stream of notes. A stream cannot see deletions: those need a full listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from notelattice.operators.parse import page_links, unique_links
from notelattice.operators.sync import PAGE_COLUMNS, batch_errors, classify, parse_changes
from notelattice.schema import MAX_WALK_DEPTH, NOTES
from notelattice.session import TEXT_CODEC, scratch_path, written
from notelattice.sources.tables import read_log, write_version
from notelattice.streaming.log import compact, current_hashes, current_links, current_pages, vacuum

#: Notes as they arrive, with their order.
ARRIVALS = T.StructType([*NOTES.fields, T.StructField("seq", T.LongType())])


def start_sync(
    notes: DataFrame,
    root: str,
    checkpoint: str,
    as_of: Column,
    directory: str = "wiki",
    max_depth: int | None = MAX_WALK_DEPTH,
) -> StreamingQuery:
    """Append the new and changed pages of every micro-batch, and their links, to the logs below ``root``.

    The version of a batch is its id, so a retried batch replaces its own output. Of several arrivals of a path in
    one batch the one with content and the highest ``seq`` (a column that notes may have) counts. Every note of
    a batch that gives no page is in the log of errors.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = current_hashes(spark, root, below=batch_id)
        # Written once: the status, the parse and the errors each read it.
        batch = written(batch, "arrived", **TEXT_CODEC)
        status = written(classify(stored, batch, directory, removals="none", max_depth=max_depth), "status")
        parsed = written(
            parse_changes(batch, status).withColumns(
                {"created_at": F.coalesce("created_at", as_of), "updated_at": as_of}
            ),
            "parsed",
            **TEXT_CODEC,
        )
        upserts = parsed.where(F.col("parse_error").isNull()).select(*PAGE_COLUMNS)
        errors = batch_errors(status, parsed, batch, directory, max_depth)
        # Errors and links first: a page version that can be seen has its links.
        write_version(errors, f"{root}/errors", batch_id)
        write_version(unique_links(page_links(upserts)), f"{root}/links", batch_id)
        write_version(upserts, f"{root}/pages", batch_id, **TEXT_CODEC)

    return (
        notes.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def replay(
    spark: SparkSession, snapshots: list[DataFrame], as_of: Column, together: bool = False, compacted: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, links, errors) after the snapshots arrived, each as a restart of the same stream or all at once.

    ``compacted``: the log is compacted after every restart and what that replaces is removed.
    """
    root = scratch_path(spark, "sync")
    for k, snapshot in enumerate(snapshots):
        snapshot.withColumn("seq", F.lit(k).cast("long")).write.mode("append").options(**TEXT_CODEC).parquet(f"{root}/arrivals")
        if together and k + 1 < len(snapshots):
            continue
        arrivals = spark.readStream.schema(ARRIVALS).parquet(f"{root}/arrivals")
        start_sync(arrivals, root, f"{root}/progress", as_of).awaitTermination()
        if compacted:
            compact(spark, root)
            vacuum(spark, root)
    errors = read_log(spark, f"{root}/errors").drop("version")
    return current_pages(spark, root), current_links(spark, root), errors
