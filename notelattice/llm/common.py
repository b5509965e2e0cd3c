"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import ctypes
import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.session import scratch_path

#: Applications that have the package on their workers.
_SHIPPED: set[str] = set()

#: The ASCII white space that separates words, as the inside of a character class.
WORD_SPACE = r"\x20\x09-\x0D"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file that Spark names, such as ``file:/x`` or ``hdfs://host/x``."""
    uri = re.sub(r"^file:/+", "/", uri)
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a job that was started from a checkout."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, str(file.relative_to(top.parent)))
    uri = scratch_path(spark, "package") + ".zip"
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(packed.getvalue())
    context.addPyFile(uri)
    _SHIPPED.add(context.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir``. The schema is kept, so no job infers it anew."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored``, and the path for ``discard``."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_batches(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches whose texts have about ``max_bytes`` together, at least one row each.

    Null texts come as empty ones.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate(sizes, 1):
            held += size
            if held >= max_bytes or i == len(sizes):
                part = batch.slice(begin, i - begin)
                # Only this slice's texts become Python strings.
                yield part, [t or "" for t in part.column(column).to_pylist()]
                begin, held = i, 0


def release_memory() -> None:
    """Give what a task has freed back to the system, so that idle workers don't hold it. No result depends on it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


CARRIED = "_carried"


def slim(docs: DataFrame, used: dict[str, str], added: list[str]) -> DataFrame:
    """Columns under the operator's own names, all others in one struct, so that no name of theirs can clash.

    ``used``: own name -> column of ``docs``. Columns that the result adds are left out.
    """
    check_columns(docs, list(used.values()), added)
    gone = {c.lower() for c in [*used.values(), *added]}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in gone]
    return docs.select(
        F.struct(*rest).alias(CARRIED) if rest else F.lit(None).cast("string").alias(CARRIED),
        *[F.col(f"`{c}`").alias(name) for name, c in used.items()],
    )


def restored(docs: DataFrame, used: dict[str, Column | str], added: list[str]) -> list[Column]:
    """The columns of ``docs`` in their order, for a result of ``slim``. ``used``: column of ``docs`` -> its value."""
    gone = {c.lower() for c in added}
    values = {c: F.col(v) if isinstance(v, str) else v for c, v in used.items()}
    return [
        (values[c] if c in values else F.col(f"{CARRIED}.`{c}`")).alias(c)
        for c in docs.columns
        if c.lower() not in gone
    ]


def with_text(docs: DataFrame, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """The columns to keep and the text, each once."""
    return docs.select(*dict.fromkeys([*keep, text_col]))


def check_columns(df: DataFrame, needed: list[str], added: list[str]) -> None:
    """Refuse an input without a needed column, or with one that the result would carry twice."""
    missing = [c for c in needed if c not in df.columns]
    clash = [c for c in added if c in needed]
    if missing or clash:
        raise ValueError(f"missing columns {missing}, clashing columns {clash}")


def word_count(text: str) -> Column:
    """Words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(rf"[^{WORD_SPACE}]+")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
