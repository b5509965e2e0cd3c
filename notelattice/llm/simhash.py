"""SimHash near-duplicates: fingerprints, sharded by vantage-point trees, linked exactly.

Fingerprints. Bit by bit the majority of the 64-bit hashes of all word shingles of the whole text.

Sharding. Equal fingerprints are one node, whatever their number. A vantage-point tree sends a fingerprint down by its
Hamming distance to the level's vantage point: inside or outside the median distance. By the triangle inequality a
fingerprint within radius r of x can only be on the other side if x is within r of the border, so x is also sent there
as a visitor. Over all 64 bits distances spread by 4 around 32, and a radius of 4 would send three in four both ways
at every level. So there are several trees, each over a band of bits: of ``blocks`` equal parts of the 64 bits, a pair
with at most ``max_distance`` different bits leaves at least ``blocks - max_distance`` intact (pigeonhole), so it
meets in the tree over some combination of that many blocks, with radius 0. ``radius`` > 0 takes fewer, wider
bands instead: one of ``blocks`` blocks has at most max_distance // blocks differing bits.

In a shard. Another vantage point orders the shard's fingerprints by their distance over all 64 bits; only those in a
window of ``max_distance`` around a fingerprint's own distance can be near it, and are compared. A shard with more than
``block_rows`` members is cut into blocks that meet pair by pair in tasks of their own. Tasks return stars, not pairs:
at most one edge per member.

Defined cases: a text without words (null too) has fingerprint 0, which is linked like any other. Repeated rows and
ties are members of one node. A group's name is its smallest id; null ids name a group only if it has no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelattice.llm.common import check_columns, ship, stored, text_batches, with_text
from notelattice.llm.components import components, merge
from notelattice.operators.skew import if_small

BITS = 64


def shingle_hashes(text: str, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit hashes of all word shingles in their order; a text of fewer words is one shingle, one of no words none."""
    words = text.encode("utf-8").lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], stops[:-1])).tolist()
    n = max(1, len(words) - shingle + 1)
    ends = (stops[min(shingle, len(words)) - 1 :] - 1).tolist()
    hashes = map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts[:n], ends, strict=True)], repeat(seed))
    return np.fromiter(hashes, np.uint64, n)


def majority(values: np.ndarray) -> int:
    """Bit by bit what more than half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 4096):
        block = values[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > len(values)))


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(
    docs: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    shingle: int = 4,
    seed: int = 42,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """``keep`` columns and ``fp``, the 64 bits as a signed number."""
    check_columns(docs, [text_col, *keep], ["fp"])
    ship(docs.sparkSession)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text_col, batch_bytes):
            values = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(values)], names=[*keep, "fp"]
            )

    return with_text(docs, keep, text_col).mapInArrow(made, f"{types}, fp long")


# ---- trees ----


def parts(blocks: int) -> list[int]:
    """Masks of ``blocks`` nearly equal parts of the 64 bits."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def bands(blocks: int, max_distance: int) -> list[tuple[int, int]]:
    """(mask, radius): every pair within ``max_distance`` is within the radius on one of the masks."""
    masks = parts(blocks)
    intact = blocks - max_distance
    if intact < 1:
        return [(m, max_distance // blocks) for m in masks]
    return [(sum(c), 0) for c in combinations(masks, intact)]


def blocks_for(n: int, max_distance: int, shard_rows: int) -> int:
    """Fewest blocks whose bands tell apart enough fingerprints for shards of about ``shard_rows``."""
    blocks = max_distance + 1
    while blocks < 16 and BITS * (blocks - max_distance) // blocks < np.log2(max(1, n / shard_rows)):
        blocks += 1
    return blocks


class Tree:
    """A vantage-point tree over the bits of a mask: per level a vantage point and the median distance to it."""

    def __init__(self, mask: int, radius: int, depth: int, sample: np.ndarray, seed: int):
        self.mask, self.radius = np.uint64(mask), radius
        points = np.random.default_rng(seed).integers(0, 1 << 63, depth, dtype=np.uint64)
        self.points = (points << np.uint64(1)) ^ (points >> np.uint64(7))
        self.medians = [int(np.median(self.distances(sample, v))) if len(sample) else BITS // 2 for v in self.points]

    def distances(self, values: np.ndarray, point: np.uint64) -> np.ndarray:
        return np.bitwise_count((values ^ point) & self.mask).astype(np.int64)

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): the leaf a value lives in, and with home false those it visits."""
        row, leaf = np.arange(len(values)), np.zeros(len(values), np.int64)
        home = np.ones(len(values), bool)
        for point, median in zip(self.points, self.medians, strict=True):
            d = self.distances(values[row], point)
            outside = d > median
            across = (d > median - self.radius) & (d <= median + self.radius) if self.radius else np.zeros(len(d), bool)
            row = np.concatenate((row, row[across]))
            leaf = np.concatenate((2 * leaf + outside, 2 * leaf[across] + ~outside[across]))
            home = np.concatenate((home, np.zeros(int(across.sum()), bool)))
        return row, leaf, home


def near_pairs(
    a: np.ndarray, b: np.ndarray, max_distance: int, chunk: int = 1 << 21
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of near values of ``a`` and ``b``, a bounded number of comparisons at a time.

    Both are ordered by distance to a vantage point; only a window around a value's distance is compared.
    """
    if not len(a) or not len(b):
        return
    point = a[0]
    da, db = np.bitwise_count(a ^ point).astype(np.int64), np.bitwise_count(b ^ point).astype(np.int64)
    order_a, order_b = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    da, db = da[order_a], db[order_b]
    lo = np.searchsorted(db, da - max_distance, "left")
    hi = np.searchsorted(db, da + max_distance, "right")
    begin = 0
    while begin < len(da):
        # Rows are sorted, so the windows of a run of them are one window.
        end = begin + 1
        while end < len(da) and (end + 1 - begin) * (hi[end] - lo[begin]) <= chunk and end - begin < 1024:
            end += 1
        first, last = lo[begin], hi[end - 1]
        x, y = a[order_a[begin:end]], b[order_b[first:last]]
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= max_distance)
        yield order_a[begin:end][i], order_b[first:last][j]
        begin = end


EDGES = "a long, b long"


def linked(
    nodes: DataFrame,
    max_distance: int = 4,
    blocks: int | None = None,
    shard_rows: int = 256,
    block_rows: int = 4096,
    sample_rows: int = 20_000,
    seed: int = 7,
) -> DataFrame:
    """Star edges ``(a, b)`` that connect exactly the distinct ``nodes(fp)`` which links connect.

    ``sample_rows`` bounds the fingerprints from which medians are learned; they only balance the shards.
    """
    ship(nodes.sparkSession)
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("fp")).limit(sample_rows).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    blocks = blocks or blocks_for(n, max_distance, shard_rows)
    masks = bands(blocks, max_distance)
    depth = max(1, int(np.ceil(np.log2(max(2, n / shard_rows)))))
    trees = [
        Tree(m, r, min(depth, m.bit_count() + 2), sample, seed + k) for k, (m, r) in enumerate(masks)
    ]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().astype(np.int64)
            for k, tree in enumerate(trees):
                row, leaf, home = tree.route(values.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), k, np.int32)), pa.array(leaf), pa.array(home), pa.array(values[row])],
                    names=["tree", "leaf", "home", "fp"],
                )

    sent = nodes.select("fp").mapInArrow(send, "tree int, leaf long, home boolean, fp long")
    sent = stored(sent, "shards")
    # At most trees * 2**depth rows, about n * trees / shard_rows.
    sizes = sent.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where("n > 1")
    cut = F.ceil(F.col("n") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("k").cast("long")).cast("int")
    placed = sent.join(sizes.select("tree", "leaf", cut.alias("k")), ["tree", "leaf"]).withColumn("own", own)
    # Block pairs (x, y) with x <= y; a member goes to every pair of its block.
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    paired = placed.withColumn("other", other).select(
        "tree",
        "leaf",
        F.least("own", "other").alias("x"),
        F.greatest("own", "other").alias("y"),
        "own",
        "home",
        "fp",
    )

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        # Equal shards of other bands may bring a value twice only as home and visitor of different leaves.
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        own, x, y = rows["own"].to_numpy(), rows["x"].iat[0], rows["y"].iat[0]
        at_a, at_b = np.flatnonzero(own == x), np.flatnonzero(own == y)
        labels = np.arange(len(fp))
        for i, j in near_pairs(fp[at_a], fp[at_b], max_distance):
            merge(labels, at_a[i], at_b[j])
        far = np.flatnonzero(labels != np.arange(len(fp)))
        values = fp.view(np.int64)
        return pd.DataFrame({"a": values[far], "b": values[labels[far]]})

    return paired.groupBy("tree", "leaf", "x", "y").applyInPandas(join, EDGES).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_distance: int = 4,
    shingle: int = 4,
    keep: tuple[str, ...] | None = None,
    **options,
) -> DataFrame:
    """``keep`` (the id by default) with ``fingerprint`` (16 hex digits), ``component_id`` and ``group`` of every row.

    ``group`` is a number for groups of two rows and more, else null. ``options`` are those of ``linked``.
    """
    keep = keep or (id_col,)
    check_columns(docs, [id_col, *keep], ["fingerprint", "component_id", "group"])
    marked = stored(fingerprints(docs, text_col, keep, shingle), "fingerprints")
    nodes = stored(
        marked.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("copies")), "nodes"
    )
    members = components(linked(nodes.select("fp"), max_distance, **options))
    found = named(marked, nodes, members, "fp", id_col)
    return found.select(
        *keep,
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        "group",
    )


def named(marked: DataFrame, nodes: DataFrame, members: DataFrame, key: str, id_col: str) -> DataFrame:
    """``marked`` with ``component_id`` and ``group``, by ``nodes(key, first, copies)`` and their components."""
    rooted = nodes.join(members.select(F.col("node").alias(key), "root"), key, "left")
    rooted = rooted.select(key, "first", "copies", F.coalesce("root", key).alias("group"))
    names = rooted.groupBy("group").agg(F.min("first").alias("_name"), F.sum("copies").alias("_size"))
    # Only groups of two and more rows; every other row names its own group. Measured, and broadcast up to a bound,
    # so that kept texts stay where they are; beyond it, joined by shuffle.
    groups = rooted.join(names.where("_size > 1").select("group", "_name"), "group").select(key, "group", "_name")
    found = marked.join(if_small(stored(groups, "groups")), key, "left")
    return found.withColumn("component_id", F.coalesce("_name", id_col)).drop("_name")


def one_of_each(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of each group of ``near_duplicates``: that of the smallest id, the smallest row if ids repeat."""
    first = F.col(id_col).eqNullSafe(F.col("component_id"))
    rest = [c for c in found.columns if c != "group"]
    grouped = found.where(first & F.col("group").isNotNull())
    chosen = grouped.groupBy("group").agg(F.min(F.struct(*rest)).alias("_row")).select("group", "_row.*")
    return found.where("group is null").unionByName(chosen).select(*found.columns)
