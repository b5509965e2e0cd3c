"""Mixing sources to target weights by capped water-filling.

The mix has as many words as the corpus. Every source gets a share by weight, but at most ``max_epochs`` times its own
size; what is cut off is shared again by weight among the others until none is above. Only one sum per round reaches
the driver. A source with target/size = 2.3 is then taken twice as a whole, and 0.3 of it once more: its documents in
a seeded order until the words are used up, the last one in part, so that every target is met to the word.

The seeded order is the order of a hash. Its high bits give ``2**bucket_bits`` buckets; bucket sums are combined
before the shuffle and summed up along each source, which says of all buckets but one per source whether they are in
or out. Only documents of that one bucket are put in order, so no source is ever sorted in one task.

Defined cases: a null text has size 0 and is taken 0 words. Null is a source of its own. Documents with equal hashes
are ordered by id and size; rows that agree in all of these are alike. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelattice.llm.common import restored, slim, stored, word_count

HASH_BITS = 32


def water_fill(sources: DataFrame, total: float, max_epochs: float = 3.0) -> DataFrame:
    """``sources(…, size, weight)`` with ``target``: shares of ``total`` by weight, none above max_epochs * size.

    A round finds the sources above their cap, which stay there; the next shares the rest among the others. The
    driver sees two sums a round. Rounds end, for every one caps at least one more source.
    """
    cap = F.col("size") * F.lit(max_epochs)
    capped = F.lit(False)
    above = -1
    while True:
        sums = sources.agg(
            F.sum(F.when(capped, cap)).alias("used"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
            F.sum(capped.cast("int")).alias("n"),
        ).first()
        free_weight = float(sums["weight"] or 0)
        level = (total - float(sums["used"] or 0)) / free_weight if free_weight else 0.0
        if (sums["n"] or 0) == above or not free_weight:
            break
        above = sums["n"] or 0
        capped = capped | (F.lit(level) * F.col("weight") > cap)
    return sources.withColumn("target", F.when(capped, cap).otherwise(F.lit(level) * F.col("weight")).cast("double"))


def by_position(sources: DataFrame, column: str, weights: list[float]) -> DataFrame:
    """Adds ``weight``: the weights in turn along the sorted values, null last.

    Sorted over ranges; a value's place is its place in its range plus the sizes of the ranges before.
    """
    spark = sources.sparkSession
    ordered = stored(
        sources.orderBy(F.col(column).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources"
    )
    part = F.shiftrightunsigned("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    return (
        ordered.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn("weight", F.element_at(listed, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
        .drop("_at", "_part", "_start")
    )


def seeded_hash(seed: int, key: Column) -> Column:
    """HASH_BITS bits of an MD5, as a number: the same in every engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: list[float] | None = None,
    max_epochs: float = 3.0,
    seed: int = 17,
    bucket_bits: int = 12,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (of the source) and ``taken`` words."""
    added = ["size", "source_size", "target", "taken"]
    used = {"id": id_col, "text": text_col, "source": source_col}
    sized = (
        slim(docs, used, added)
        .withColumn("size", word_count("text"))
        .withColumn("_order", seeded_hash(seed, F.col("id")))
        .withColumn("_bucket", F.shiftright("_order", HASH_BITS - bucket_bits))
    )
    sums = stored(
        sized.groupBy(F.col("source").alias("_source"), "_bucket").agg(F.sum("size").alias("_words")), "words"
    )
    sources = sums.groupBy("_source").agg(F.sum("_words").alias("size"))
    total = sums.agg(F.sum("_words")).first()[0] or 0
    weighted = stored(by_position(sources, "_source", weights or [5, 2, 1]), "weights")
    filled = water_fill(weighted, float(total), max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = (
        filled.select("_source", F.col("size").alias("source_size"), "target")
        .withColumn("_whole", F.floor(ratio))
        .withColumn("_part", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    )
    same = F.col("_a.source_key").eqNullSafe(F.col("_b.source_key"))
    until = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("_before", F.coalesce(F.sum("_words").over(until), F.lit(0)))
    edges = (
        running.withColumn("source_key", F.col("_source")).alias("_a")
        .join(plan.withColumn("source_key", F.col("_source")).alias("_b"), same)
        .where((F.col("_before") < F.col("_part")) & (F.col("_before") + F.col("_words") >= F.col("_part")))
        .select(F.col("_b.source_key").alias("_key"), F.col("_bucket").alias("_edge"), "_before")
    )
    # One row per source: its plan and the bucket in which its extra words end.
    rules = stored(
        plan.join(edges, F.col("_source").eqNullSafe(F.col("_key")), "left").drop("_key"), "mix-rules"
    )
    placed = sized.join(rules, F.col("source").eqNullSafe(F.col("_source")), "left")
    extra = F.when(F.col("_bucket") < F.col("_edge"), F.col("size")).otherwise(F.lit(0))
    outside = placed.where(F.col("_edge").isNull() | (F.col("_bucket") != F.col("_edge")))
    edge = placed.where(F.col("_bucket") == F.col("_edge"))
    inside = Window.partitionBy("_source").orderBy("_order", "id", "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    edge = edge.withColumn(
        "_extra", F.least(F.greatest(F.col("_part") - (upto - F.col("size")), F.lit(0)), F.col("size"))
    )
    both = outside.withColumn("_extra", extra).unionByName(edge)
    return both.select(
        *restored(docs, {id_col: "id", text_col: "text", source_col: "source"}, added),
        "size",
        "source_size",
        "target",
        (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long").alias("taken"),
    )


def repeated(mixed: DataFrame, text_col: str = "text", whole: bool = False) -> DataFrame:
    """The rows of the mix (as ``mix`` returns it): a document once per whole repetition, and once more with its first words for a part.

    The part's words are joined by single spaces. With ``whole`` a part of half a document and more is the whole document
    and a smaller one nothing, so every text stays as it is. Rows that nothing is taken of go.
    """
    size, taken = F.col("size"), F.col("taken")
    times = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(0)).cast("int")
    rest = F.when(size > 0, taken % size).otherwise(F.lit(0)).cast("int")
    names = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken")]
    if whole:
        times = times + F.when(2 * rest >= size, F.lit(1)).otherwise(F.lit(0))
    copies = mixed.where((size > 0) & (taken > 0)).where(times > 0).select(
        *names, F.explode(F.array_repeat(F.lit(0), times))
    ).select(*names)
    if whole:
        return copies
    words = F.split(F.btrim(F.col(text_col), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    part = F.array_join(F.slice(words, F.lit(1), rest), " ")
    parts = mixed.where((size > 0) & (taken % size > 0))
    parts = parts.select(*[part.alias(c) if c == text_col else F.col(c) for c in names])
    return copies.unionByName(parts)
