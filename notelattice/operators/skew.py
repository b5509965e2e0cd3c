"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 200  # a key is hot when it holds more than 1/HOT_SHARE of the rows, so fewer than HOT_SHARE are
SALTS = 32
HASH_BITS = 1 << 24
BROADCAST_BYTES = 16 << 20  # of a stored table whose size was measured; the driver holds it several times over


def if_small(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``table`` marked for broadcast if its rows take up to ``max_bytes``, else ``table`` itself.

    For written tables: they are read once to be measured, nested columns with all they hold. The result of a join is the
    same either way.
    """

    def size(c: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if kind.startswith(("array", "map", "struct")):  # JSON has the contents; offsets and padding take about as much
            return 16 + 2 * F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        return F.lit(16)

    total = F.lit(16)
    for c, kind in table.dtypes:
        total = total + size(c, kind)
    measured = table.agg(F.sum(total)).first()[0] or 0
    return F.broadcast(table) if measured <= max_bytes else table


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than 1/HOT_SHARE of all rows: always fewer than HOT_SHARE rows, so safe to broadcast.

    Counting combines before the shuffle; only the key column is read.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("total")).scalar()
    return counts.where((F.col("_n") * HOT_SHARE > total) & (F.col("_n") > SALTS)).select("_hot")


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str, hot: DataFrame | None = None) -> DataFrame:
    """``big`` join ``small`` on ``key``, with the hot keys of ``big`` spread over SALTS buckets.

    Only rows of hot keys are repeated on the small side. The salt is a hash of the row, so a recomputed
    task puts every row where it was before. ``how`` is inner, left, left_semi or left_anti; columns of the
    two sides other than ``key`` must have different names.
    """
    hot = F.broadcast(hot_keys(big, key) if hot is None else hot)
    plain = [c for c, kind in big.dtypes if not kind.startswith(("map", "variant"))]
    spread = F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int")
    left = (
        big.join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.when(F.col("_hot").isNotNull(), spread).otherwise(F.lit(0)))
        .drop("_hot")
    )
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    right = small.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def maybe_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be in ``keys(key)``: all that are, and of the others those with the hash of one.

    The hashes are bits of at most HASH_BITS / 64 words, so they can be broadcast whatever the number of keys.
    """
    place = F.pmod(F.xxhash64(key), F.lit(HASH_BITS))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    words = keys.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(words), "_word")
    return marked.where(F.getbit("_bits", (F.col("_place") % 64).cast("int")) == 1).select(*rows.columns)


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the first by ``order``. Copies combine before the shuffle, unlike with row_number."""
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return chosen.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
