"""Embedding near-duplicates: an exact metric range join over pivots.

Vectors are scaled to length 1, where cosine >= c means a distance of at most eps = sqrt(2 - 2c). Equal vectors of a label
are one node with a count. A bounded sample gives pivots; a node lives in the cell of its nearest pivot p. It visits
the cell of another pivot q only if a point that lives there could be within eps of it:
  d(x, q) - d(x, p) <= 2 eps                              (triangle inequality, twice)
  (d(x, q)^2 - d(x, p)^2) / (2 d(p, q)) <= eps            (distance to the plane between the cells)
  d(x, q) <= eps + the cell's radius                      (triangle inequality)
All links of a node are then found in its own cell, and cells are joined independently: residents with residents and
visitors. A cell with more than ``block_rows`` members is cut into blocks that meet in tasks of their own. Tasks return
one row per member (a count of links and one star edge), never pairs; the exact test is the cosine in double precision.

Defined cases: vectors that are null, empty, zero or have null or non-finite components, and rows without label, link
with nothing and stay. Vectors of different dimensions don't link. Repeated rows are members of one node and link with
each other. A component's name is its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.llm.common import check_columns, ship, stored
from notelattice.llm.components import components, merge

#: Added to every bound, for rounding; the exact test follows.
LEEWAY = 1e-6


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, through their largest component, so that no square under- or overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def matrix(column: pd.Series | list) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


class Pivots:
    """Pivots of one label and dimension, with the radius of each cell once it is known."""

    def __init__(self, points: np.ndarray, eps: float):
        self.points, self.eps = points, eps
        self.between = distances(points, points)

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(vectors, self.points)
        return d, d.argmin(axis=1)

    def visits(self, vectors: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, home) of all cells in which a vector has to be."""
        d, home = self.homes(vectors)
        own = d[np.arange(len(d)), home][:, None]
        # Between pivots of nearly one direction the distance is mostly rounding, so the leeway can't depend on it.
        plane = (d * d - own * own) <= 2 * self.between[home] * (self.eps + LEEWAY) + LEEWAY
        near = (d - own <= 2 * self.eps + LEEWAY) & plane & (d <= radius[None, :] + self.eps + LEEWAY)
        near[np.arange(len(d)), home] = True
        row, cell = np.nonzero(near)
        return row, cell, cell == home[row]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


def choose_pivots(nodes: DataFrame, per_group: int, max_pivots: int, eps: float) -> dict[tuple[int, int], Pivots]:
    """For every (label, dimension) a number of pivots that grows with the root of its nodes, ``max_pivots`` in all."""
    sizes = nodes.groupBy("label", F.size("v").alias("dim")).count().orderBy(F.desc("count")).limit(max_pivots).collect()
    wanted = {(x["label"], x["dim"]): min(per_group, max(1, int(x["count"] ** 0.5 / 8))) for x in sizes}
    shrink = max(1.0, sum(wanted.values()) / max_pivots)
    share = {k: max(1, int(n / shrink)) for k, n in wanted.items()}
    count = {(x["label"], x["dim"]): x["count"] for x in sizes}
    rate = {k: min(1.0, 4 * n / count[k]) for k, n in share.items()}
    if not share:
        return {}
    chance = F.pmod(F.xxhash64("v"), F.lit(1_000_000)) / 1_000_000
    listed = F.coalesce(*[
        F.when((F.col("label") == label) & (F.size("v") == dim), F.lit(r)) for (label, dim), r in rate.items()
    ])
    rows = nodes.where(chance < listed).orderBy(F.xxhash64("v", F.lit(1))).limit(8 * max_pivots)
    drawn: dict[tuple[int, int], list] = {}
    for x in rows.select("label", "v").toArrow().to_batches(1024):
        for label, v in zip(x["label"].to_pylist(), x["v"], strict=True):
            kept = drawn.setdefault((label, len(v)), [])
            if len(kept) < share[label, len(v)]:
                kept.append(v.values.to_numpy(zero_copy_only=False))
    return {k: Pivots(units(matrix(v)), eps) for k, v in drawn.items()}


def range_links(
    nodes: DataFrame,
    min_cosine: float = 0.98,
    per_group: int = 256,
    max_pivots: int = 4096,
    block_rows: int = 4096,
) -> DataFrame:
    """``(node, links, root)`` for ``nodes(node, label, v, copies)``: rows linked in other nodes, and star edges.

    A node may have several rows, one for each block it met. ``max_pivots`` bounds the pivots of all labels together,
    which every task receives.
    """
    ship(nodes.sparkSession)
    eps = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    pivots = choose_pivots(nodes, per_group, max_pivots, eps)
    label_type = dict(nodes.dtypes)["label"]

    def by_group(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        labels, vectors = batch.column("label").to_pylist(), batch.column("v").to_pylist()
        groups: dict[tuple, list[int]] = {}
        for i, (label, v) in enumerate(zip(labels, vectors, strict=True)):
            groups.setdefault((label, len(v)), []).append(i)
        for key, rows in groups.items():
            yield key, np.array(rows), units(matrix([vectors[i] for i in rows]))

    # A label beyond the bound, or one the sample missed, is one cell; blocks keep it in bounds.
    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[tuple, np.ndarray] = {}
        label_kind = pa.null()
        for batch in batches:
            label_kind = batch.schema.field("label").type
            for key, _, x in by_group(batch):
                if key in pivots:
                    d, home = pivots[key].homes(x)
                    far = most.setdefault(key, np.zeros(len(pivots[key].points)))
                    np.maximum.at(far, home, d[np.arange(len(d)), home])
        rows = [(k[0], k[1], i, float(r)) for k, far in most.items() for i, r in enumerate(far)]
        if rows:
            labels, dims, cells, radii = zip(*rows, strict=True)
            kinds = [label_kind, pa.int32(), pa.int32(), pa.float64()]
            arrays = [pa.array(x, t) for x, t in zip((labels, dims, cells, radii), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["label", "dim", "cell", "radius"])

    measured = nodes.select("label", "v").mapInArrow(radii, f"label {label_type}, dim int, cell int, radius double")
    radius = {k: np.zeros(len(p.points)) for k, p in pivots.items()}
    for x in measured.groupBy("label", "dim", "cell").agg(F.max("radius").alias("r")).collect():  # max_pivots rows
        radius[x["label"], x["dim"]][x["cell"]] = x["r"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows, x in by_group(batch):
                if key in pivots:
                    row, cell, home = pivots[key].visits(x, radius[key])
                else:
                    row, cell, home = np.arange(len(x)), np.zeros(len(x), int), np.ones(len(x), bool)
                for at in range(0, len(row), 20_000):
                    part = slice(at, at + 20_000)
                    kept = batch.take(pa.array(rows[row[part]]))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(np.full(len(kept), key[1], np.int32)),
                         pa.array(cell[part].astype(np.int32)), pa.array(home[part])],
                        names=[*kept.schema.names, "dim", "cell", "home"],
                    )

    slim = nodes.select("node", "label", "v", "copies")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    sent = slim.mapInArrow(send, f"{schema}, dim int, cell int, home boolean")
    sent = stored(sent, "cells")
    cells = ["label", "dim", "cell"]
    cut = F.ceil(F.count("*") / block_rows).cast("int")
    blocks = sent.groupBy(*cells).agg(cut.alias("k"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = F.pmod(F.xxhash64("node"), F.col("k").cast("long")).cast("int")
    placed = sent.join(blocks, cells).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    # Residents of block x with members of block y: a resident goes to (own, *), any member to (*, own).
    member = ["node", "v", "copies"]
    left = placed.where("home").select(*cells, F.col("own").alias("x"), other.alias("y"), F.lit(True).alias("asks"), *member)
    right = placed.select(*cells, other.alias("x"), F.col("own").alias("y"), F.lit(False).alias("asks"), *member)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        node, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"node": [], "links": [], "root": []}, dtype=np.int64)
        x = units(matrix(rows["v"]))
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        names, index = np.unique(node, return_inverse=True)
        labels, links = np.arange(len(names)), np.zeros(len(names), np.int64)
        for at in range(0, len(a), 256):
            part = a[at : at + 256]
            i, j = np.nonzero(x[part] @ x[b].T >= min_cosine)
            i, j = index[part][i], b[j]
            other = i != index[j]
            i, j = i[other], j[other]
            np.add.at(links, i, copies[j])
            merge(labels, i, index[j])
        return pd.DataFrame({"node": names, "links": links, "root": names[labels]})

    both = left.unionByName(right)
    found = both.groupBy(*cells, "x", "y").applyInPandas(join, "node long, links long, root long")
    return found.where("links > 0 or node != root")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = 0.98,
    **options,
) -> DataFrame:
    """Per row: ``id_col``, ``n_links``, ``component_id`` and ``kept``. ``options`` are those of ``range_links``."""
    check_columns(vectors, [id_col, vector_col, label_col], ["n_links", "component_id", "kept"])
    rows = vectors.select(
        F.col(id_col).alias("id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    # -0.0 and 0.0 are one number here; a node is a hash of 64 bits below its exact vector.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    good = usable(F.col("v")) & F.col("label").isNotNull() & F.exists("v", lambda x: x != 0)
    rows = stored(rows.withColumn("good", F.coalesce(good, F.lit(False))), "vectors")
    classes = rows.where("good").groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = stored(range_links(nodes, min_cosine, **options), "links")
    members = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = (
        nodes.join(members, "node", "left")
        .join(links, "node", "left")
        .select("label", "v", "first", "copies", F.coalesce("root", "node").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # Rows of one vector without links name themselves; the others meet their node.
    groups = stored(rooted.where("n_links > 0").join(names, "root").select("label", "v", "n_links", "component_id"), "groups")
    linked = rows.join(groups, ["label", "v"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return linked.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
