"""The corpus pipeline: documents to packed training sequences, one operator per stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.llm import langid
from notelattice.llm.common import stored, table
from notelattice.llm.line_dedup import drop_boilerplate
from notelattice.llm.mixing import mix, repeated
from notelattice.llm.near_copies import near_copies
from notelattice.llm.packing import pack_documents
from notelattice.llm.simhash import one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Language ID, packing and near duplicates train models or encode tokens, which SQL cannot express.
ORACLE_SQL: str | None = None


#: What the stages need of a document; further columns don't go through the pipeline.
COLUMNS = ("doc_id", "text", "lang", "source")


def _like_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model doesn't reject; with the language it found."""
    model = langid.fit(docs.select(*COLUMNS))
    known = langid.identify(docs, model, keep=COLUMNS)
    return _like_documents(known.where("not rejected").withColumn("lang", F.coalesce("lang", "lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on more than a tenth of their source's documents."""
    return _like_documents(drop_boilerplate(docs.select(*COLUMNS)))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 and more), that with the smallest id."""
    return _like_documents(one_of_each(near_copies(docs, shingle=5, min_jaccard=0.8, keep=COLUMNS)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _like_documents(repeated(mix(docs.select(*COLUMNS), weights=[5, 2, 1]), whole=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in the training sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
