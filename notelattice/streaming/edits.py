"""A stream of page edits. The state of every page is its newest row in the page log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notelattice.functions.text import normalize_slug
from notelattice.operators.edits import apply_edits
from notelattice.schema import EDITS, PAGES
from notelattice.session import scratch_path
from notelattice.sources.tables import write_version
from notelattice.streaming.log import current_pages


def start_edits(edits: DataFrame, root: str, checkpoint: str, as_of: Column) -> StreamingQuery:
    """Apply every micro-batch of edits to the pages it names; append pages, links and results to the logs."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = batch_id + 1  # version 0 is the state before the stream
        named = batch.select(normalize_slug(F.col("slug")).alias("slug")).distinct()
        touched = current_pages(spark, root, below=version).join(named, "slug", "left_semi")
        outcome = apply_edits(touched, batch, as_of)
        write_version(outcome.results, f"{root}/results", version)
        write_version(outcome.raw_notes, f"{root}/raw_notes", version)
        write_version(outcome.new_links, f"{root}/links", version)
        write_version(outcome.upserts, f"{root}/pages", version)

    return (
        edits.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def replay(spark: SparkSession, pages: DataFrame, arrivals: list[DataFrame], as_of: Column) -> DataFrame:
    """Pages touched by edits that arrive in parts, each part as a restart of the same stream."""
    root = scratch_path(spark, "edits")
    write_version(pages.select(*PAGES.fieldNames()), f"{root}/pages", 0)
    for part in arrivals:
        part.write.mode("append").parquet(f"{root}/arrivals")
        stream = spark.readStream.schema(EDITS).parquet(f"{root}/arrivals")
        start_edits(stream, root, f"{root}/progress", as_of).awaitTermination()
    results = spark.read.parquet(f"{root}/results").where("status = 'applied'").select("slug").distinct()
    return current_pages(spark, root).join(results, "slug", "left_semi")
