"""Connected components of an edge table, by large-star and small-star rounds.

Every round links all larger neighbours of a node to the smallest one it knows, then all smaller ones; paths halve and
components end as stars. A round is two aggregates with a combine before the shuffle, and two joins in which only the
edge side can have a hot node, which Spark splits. Each round is a table in the shared folder. Edges between the same
nodes count once; nodes without edges don't appear.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelattice.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` with u > v: neighbours above a node go to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it go to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)``: every node that has an edge to another one, with the smallest node of its component."""
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges, "edges")
    before = _mark(edges)
    while before[0]:
        edges = stored(_small_star(stored(_large_star(edges), "large-star")), "small-star")
        after = _mark(edges)
        if after == before:
            break
        before = after
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of ``i`` and ``j`` pair by pair; labels are the smallest index of each group."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further
