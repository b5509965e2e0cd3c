"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least ``min_jaccard``.

Candidates. Texts of the same words are one node. Two nodes are candidates if they share a bucket: the group that their
SimHash fingerprints form (links of at most ``max_distance`` bits, exact), or one of ``bands`` bands of ``rows``
minima of hashed shingles each. A pair of Jaccard j is missed by all bands with a chance of (1 - j^rows)^bands, less
than 3 in 100,000 for 0.8. SimHash alone would have to link fingerprints up to 16 of 64 bits apart for that, where
bands of bits prune so little that the work grows with nearly all pairs.

Confirmation. Only the exact Jaccard similarity of the whole shingle sets (of 64-bit hashes) links. First every member of
a bucket is compared with the bucket's smallest node, which joins large groups of near copies without their pairs. Buckets
that then still have members of several groups are compared in tasks, all members with all, and return one edge
per member; those with more than ``block_rows`` members are cut into blocks that meet pair by pair in tasks of their
own. No bucket is capped. Shingles of candidates alone are made a second time and move.

Defined cases: texts without words (null too) are one node. A text of fewer words than a shingle is one shingle. A
group's name is its smallest id; null ids name a group only if it has no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelattice.llm.common import check_columns, release_memory, ship, stored, text_batches, with_text
from notelattice.llm.components import components, merge
from notelattice.llm.simhash import EDGES, linked, majority, named, shingle_hashes
from notelattice.operators.skew import if_small

SEED = 42


def minima(values: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed number for each band: a hash of the least shingle in ``rows`` orders. None without shingles."""
    if not len(values):
        return []
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 2048):
        np.minimum(least, (factors[:, None] * values[None, at : at + 2048]).min(axis=1), out=least)
    parts = least.astype("<u8").reshape(bands, rows)
    digests = [xxhash.xxh64_intdigest(p.tobytes(), seed=k) for k, p in enumerate(parts)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def words_key(text: str) -> int:
    """A signed hash of the words, as ``shingle_hashes`` sees them."""
    joined = b" ".join(text.encode("utf-8").lower().split())
    return int(np.uint64(xxhash.xxh64_intdigest(joined, seed=SEED)).astype(np.int64))


def enough(common: np.ndarray, a: np.ndarray, b: np.ndarray, min_jaccard: float) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` with so many common members reach the similarity."""
    return common >= min_jaccard * (a + b - common) - 1e-9


def near_sets(a: list[np.ndarray], b: list[np.ndarray], min_jaccard: float) -> Iterator[tuple[int, np.ndarray]]:
    """For every set of ``a`` its place and those of the sets of ``b`` that are near, by counts over an inverted list."""
    sizes = np.array([len(x) for x in b], np.int64)
    owner = np.repeat(np.arange(len(b)), sizes)
    values = np.concatenate([*b, np.zeros(0, np.int64)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for i, x in enumerate(a):
        lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        common = np.bincount(owner[at], minlength=len(b))
        yield i, np.flatnonzero((common > 0) & enough(common, len(x), sizes, min_jaccard))


def confirmed(members: DataFrame, sets: DataFrame, min_jaccard: float, block_rows: int) -> DataFrame:
    """Star edges ``(a, b)`` that connect the nodes which near pairs connect.

    ``members(bucket, node)``, each once; ``sets(node, words, size)`` with sorted distinct hashes and their number.
    """
    # Buckets of the same members count once.
    alike = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node") % 1_000_003).alias("s"))
    buckets = members.groupBy("bucket").agg(alike.alias("alike"), F.min("node").alias("lead")).where("alike.n > 1")
    buckets = buckets.groupBy("alike", "lead").agg(F.min("bucket").alias("bucket")).select("bucket", "lead", "alike.n")
    members = stored(members.join(buckets, "bucket"), "members")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            hit = []
            for i in range(len(batch)):
                u, v = x[i].values.to_numpy(), y[i].values.to_numpy()
                common = len(u) + len(v) - len(np.union1d(u, v))
                hit.append(common > 0 and bool(enough(common, len(u), len(v), min_jaccard)))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))
        release_memory()

    stars = members.where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    # Sets too unlike in size can't be near; only the others' hashes move.
    stars = stars.join(sets.select(F.col("node").alias("a"), F.col("size").alias("n")), "a")
    stars = stars.join(sets.select(F.col("node").alias("b"), F.col("size").alias("m")), "b")
    like = min_jaccard * F.greatest("n", "m") <= F.least("n", "m") + 1e-9
    stars = stored(stars.where(like).select("a", "b"), "stars")
    first = sets.select(F.col("node").alias("b"), F.col("words").alias("y"))
    second = sets.select(F.col("node").alias("a"), F.col("words").alias("x"))
    sure = stored(stars.join(first, "b").join(second, "a").select("a", "b", "x", "y").mapInArrow(near, EDGES), "sure")
    known = components(sure).select("node", F.col("root").alias("known"))
    # Two members have met as member and smallest; larger buckets of several groups need all pairs.
    open_ = members.where("n > 2").join(known, "node", "left").withColumn("known", F.coalesce("known", "node"))
    open_ = stored(open_.select("bucket", "node", "known", "n"), "open")
    mixed = open_.groupBy("bucket").agg(F.min("known").alias("u"), F.max("known").alias("v")).where("u != v").select("bucket")
    cut = F.ceil(F.col("n") / block_rows).cast("int")
    placed = open_.join(mixed, "bucket").withColumn("k", cut)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k").cast("long")).cast("int"))
    paired = placed.join(sets.drop("size"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    paired = paired.select(
        "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "known", "words"
    )

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        node, own, x, y = rows["node"].to_numpy(), rows["own"].to_numpy(), rows["x"].iat[0], rows["y"].iat[0]
        words = [np.asarray(w, np.int64) for w in rows["words"]]
        _, first, known = np.unique(rows["known"].to_numpy(), return_index=True, return_inverse=True)
        labels = first[known].copy()  # the smallest place of each group
        before = labels.copy()
        at_a, at_b = np.flatnonzero(own == x), np.flatnonzero(own == y)
        for i, j in near_sets([words[k] for k in at_a], [words[k] for k in at_b], min_jaccard):
            merge(labels, np.full(len(j), at_a[i]), at_b[j])
            if not labels.any():
                break
        far = np.flatnonzero(labels != before)
        return pd.DataFrame({"a": node[far], "b": node[labels[far]]})

    # A task's groups were joined through stars already, whose edges are in ``sure``.
    rest = paired.groupBy("bucket", "x", "y").applyInPandas(join, EDGES)
    return stored(sure.unionByName(rest), "confirmed")


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    min_jaccard: float = 0.8,
    max_distance: int = 4,
    bands: int = 20,
    rows: int = 4,
    keep: tuple[str, ...] | None = None,
    batch_bytes: int = 1 << 20,
    block_rows: int = 1024,
) -> DataFrame:
    """``keep`` (the id by default) with ``component_id`` and ``group`` of every row, as ``simhash.near_duplicates``."""
    keep = keep or (id_col,)
    check_columns(docs, [id_col, text_col, *keep], ["component_id", "group", "node", "fp", "bands"])
    ship(docs.sparkSession)
    slim = with_text(docs, (id_col, *keep), text_col)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text_col, batch_bytes):
            hashes = [shingle_hashes(t, shingle, SEED) for t in texts]
            values = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            found = [minima(h, bands, rows) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([words_key(t) for t in texts], pa.int64()), pa.array(values),
                 pa.array(found, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "node", "fp", "bands"],
            )
        release_memory()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text", batch_bytes):
            found = [np.unique(shingle_hashes(t, shingle, SEED).view(np.int64)) for t in texts]
            kind, sizes = pa.list_(pa.int64()), pa.array([len(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, kind), sizes], names=["node", "words", "size"])
        release_memory()

    marked = stored(slim.mapInArrow(marks, f"{types}, node long, fp long, bands array<long>"), "marked")
    nodes = marked.groupBy("node", "fp", "bands").agg(F.min(id_col).alias("first"), F.count("*").alias("copies"))
    nodes = stored(nodes, "nodes")
    prints = stored(nodes.where(F.size("bands") > 0).select("fp").distinct(), "prints")
    joined = components(linked(prints, max_distance)).select(F.col("node").alias("fp"), "root")
    prints = nodes.where(F.size("bands") > 0).join(joined, "fp", "left")
    groups = prints.select(F.xxhash64(F.coalesce("root", "fp")).alias("bucket"), "node")
    members = groups.unionByName(nodes.select(F.explode("bands").alias("bucket"), "node")).distinct()
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stored(members.join(shared, "bucket"), "buckets")
    wanted = if_small(stored(members.select("node").distinct(), "wanted"))
    texts = marked.select("node", F.col(text_col).alias("text")).join(wanted, "node", "left_semi")
    texts = texts.groupBy("node").agg(F.min("text").alias("text"))
    sets = stored(texts.mapInArrow(shingles, "node long, words array<long>, size long"), "shingles")
    found = components(confirmed(members, sets, min_jaccard, block_rows))
    return named(marked, nodes.select("node", "first", "copies"), found, "node", id_col).select(*keep, "component_id", "group")
