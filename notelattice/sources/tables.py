"""Versioned parquet tables: every write is a new ``version=N`` folder, the newest finished one is current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str, version: int, **options: str) -> None:
    """Write one version. Repeating it (a retried batch) replaces the same folder."""
    df.write.mode("overwrite").options(**options).parquet(f"{root}/version={version}")


def finished_versions(spark: SparkSession, root: str) -> list[int]:
    """Versions whose write was committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().removeprefix("version=")) for s in found or [])


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """One version as it was written; the newest by default."""
    version = finished_versions(spark, root)[-1] if version is None else version
    return spark.read.parquet(f"{root}/version={version}")


def read_log(spark: SparkSession, root: str, below: int | None = None, after: int | None = None) -> DataFrame:
    """All finished versions (within bounds) as one table with a ``version`` column: an append-only log."""
    versions = [
        v for v in finished_versions(spark, root) if (below is None or v < below) and (after is None or v > after)
    ]
    log = spark.read.option("basePath", root).parquet(*[f"{root}/version={v}" for v in versions])
    return log.withColumn("version", F.col("version").cast("long"))
