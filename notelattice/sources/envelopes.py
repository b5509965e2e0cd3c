"""Landed service responses ``{code, status, message, data}``, one JSON text per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.schema import ENVELOPE

# Fixed values of the response format.
CODE_OK = 1
CODE_NOT_FOUND = 430
NOT_FOUND_MESSAGE = "Note does not exist"


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Response texts of a folder of line-delimited JSON files."""
    return spark.read.text(path)


def decode_envelopes(responses: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(notes ``(path, raw_content)``, errors ``(stage, message)``). A null list is an empty one."""
    decoded = responses.select(F.from_json(column, ENVELOPE).alias("r")).select("r.*")
    listed = (
        decoded.where(F.col("code") == CODE_OK)
        .select(F.explode("data.list").alias("note"))
        .select("note.path", F.col("note.content").alias("raw_content"))
    )
    notes = listed.where(F.col("path").isNotNull())
    nameless = listed.where(F.col("path").isNull()).select(
        F.lit("listing").alias("stage"), F.lit("note without a path").alias("message")
    )
    stage = (
        F.when(F.col("code").isNull(), F.lit("decode"))
        .when(F.col("code") == CODE_NOT_FOUND, F.lit("not_found"))
        .otherwise(F.lit("service"))
    )
    message = (
        F.when(F.col("code").isNull(), F.lit("invalid response"))
        .when(F.col("code") == CODE_NOT_FOUND, F.coalesce("message", F.lit(NOT_FOUND_MESSAGE)))
        .otherwise(F.coalesce("message", F.lit("")))
    )
    errors = decoded.where(F.col("code").isNull() | (F.col("code") != CODE_OK)).select(
        stage.alias("stage"), message.alias("message")
    )
    return notes, errors.unionByName(nameless)


def listing_status(responses: DataFrame, column: str = "value", folder: str = "folder") -> DataFrame:
    """``(folder, received, total, complete)`` of landed listing responses that say which folder they list.

    A listing is complete when as many notes arrived as its pager counts and no response for the folder failed.
    """
    decoded = responses.select(F.col(folder).alias("folder"), F.from_json(column, ENVELOPE).alias("r"))
    fine = F.coalesce(F.col("r.code") == CODE_OK, F.lit(False))
    listed = F.when(fine, F.coalesce(F.size("r.data.list"), F.lit(0))).otherwise(F.lit(0))
    sums = decoded.groupBy("folder").agg(
        F.sum(F.greatest(listed, F.lit(0))).alias("received"),
        F.max("r.data.pager.totalRows").alias("total"),
        F.min(fine).alias("_fine"),
    )
    whole = F.col("_fine") & F.coalesce(F.col("received") >= F.col("total"), F.lit(False))
    return sums.select("folder", "received", "total", whole.alias("complete"))


def incomplete_folders(responses: DataFrame, column: str = "value", folder: str = "folder") -> DataFrame:
    """``(folder)`` whose listing is not whole: ``sync`` keeps what lies below them."""
    return listing_status(responses, column, folder).where("not complete").select("folder")


def encode_envelopes(pages_of_notes: DataFrame) -> DataFrame:
    """Response texts ``value`` from ``(code, message, notes)`` rows; the inverse of decoding, used for landing.

    ``total`` (the pager's count, else the size of ``notes``) and ``folder`` are taken along if they are there.
    """
    has = set(pages_of_notes.columns)
    total = F.col("total") if "total" in has else F.size("notes")
    return pages_of_notes.select(
        *[F.col("folder")] * ("folder" in has),
        F.to_json(
            F.struct(
                F.col("code"),
                (F.col("code") == CODE_OK).alias("status"),
                F.col("message"),
                F.struct(
                    F.col("notes").alias("list"),
                    F.struct(total.cast("long").alias("totalRows")).alias("pager"),
                ).alias("data"),
            )
        ).alias("value")
    )
