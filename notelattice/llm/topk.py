"""Exact top-k by inner product: a ball tree per shard, branch and bound.

Candidates are dealt to shards by a hash and sent once. A shard builds its ball tree when its points are there, and
the queries then stream through it in blocks. A node's bound for a query is q.c + |q| r, no inner product below it is
larger. Nodes are visited in the order of their best bound, and only with the queries whose bound reaches the current
kth score, which is shared by all nodes of the shard. Shards come in waves (the first, then those up to 16, 256 and so
on), and each wave starts from the kth scores of all waves before, which are lower bounds.

Queries are a stated set and meet every shard, so queries times shards of ``shard_rows`` points are sent; a task holds one
shard and one batch of queries, and returns at most k rows a query and shard.
Components are whole numbers, so scores are exact: in double precision while sums stay below 2**53, in Python's
integers beyond, held to 64 bits in the result. The order is by score, then by smaller id.

Defined cases: vectors that are null or have null or non-finite components take no part, as query or as candidate. An
empty vector has score 0 with everything; shorter vectors count as padded with zeros. Rows that repeat an id are
candidates of their own; a query doesn't meet rows of its own id, and a repeated query counts once per distinct vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelattice.llm.common import check_columns, ship, stored

LEAF = 64
EXACT = 1 << 53
LONG = (1 << 63) - 1
WAVE = 16  # each wave takes the shards up to WAVE times those before


def padded(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of one width, that of the longest or the given one; longer ones are cut, shorter ones filled with zeros."""
    width = max((len(v) for v in column), default=0) if width is None else width
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v[:width]
    return out


class BallTree:
    """Nodes in arrays: rows ``start`` to ``stop`` of the order, centre, radius and children."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.start, self.stop, self.centre, self.radius, self.children = [], [], [], [], []
        self._build(points, 0, len(points))

    def _build(self, points: np.ndarray, start: int, stop: int) -> int:
        rows = points[self.order[start:stop]]
        centre = rows.mean(axis=0)
        apart = ((rows - centre) ** 2).sum(axis=1)
        node = len(self.start)
        self.start.append(start)
        self.stop.append(stop)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(apart.max())))
        self.children.append(())
        if stop - start > LEAF and apart.max() > 0:
            # Split between the point farthest from the centre and the one farthest from that.
            a = rows[apart.argmax()]
            b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
            side = np.argsort(rows @ (b - a), kind="stable")
            self.order[start:stop] = self.order[start:stop][side]
            middle = (start + stop) // 2
            self.children[node] = (self._build(points, start, middle), self._build(points, middle, stop))
        return node


class Best:
    """The k best (score, smaller id) of every query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        k = self.scores.shape[1]
        all_scores = np.concatenate((self.scores[rows], scores), axis=1)
        all_ids = np.concatenate((self.ids[rows], np.broadcast_to(ids, scores.shape)), axis=1)
        # Scores are compared before ids: a stable sort by id, then by score.
        by_id = np.argsort(all_ids, axis=1, kind="stable")
        all_scores, all_ids = np.take_along_axis(all_scores, by_id, 1), np.take_along_axis(all_ids, by_id, 1)
        best = np.argsort(-all_scores, axis=1, kind="stable")[:, :k]
        self.scores[rows] = np.take_along_axis(all_scores, best, 1)
        self.ids[rows] = np.take_along_axis(all_ids, best, 1)


def search(tree: BallTree, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """Best first over the nodes of one shard, all queries of a block together."""
    best = Best(len(queries), k, floor)
    points = tree.points
    centres, radii = np.stack(tree.centre), np.array(tree.radius)
    length = np.sqrt((queries * queries).sum(axis=1))
    # Rounding of the bound is far below one unit while sums are exact.
    bounds = queries @ centres.T + length[:, None] * radii[None, :] * (1 + 1e-9) + 1.0
    open_nodes = [(-float(bounds[:, 0].max()), 0)]
    while open_nodes:
        _, node = heapq.heappop(open_nodes)
        rows = np.flatnonzero(bounds[:, node] >= best.kth())
        if not len(rows):
            continue
        if tree.children[node]:
            for child in tree.children[node]:
                heapq.heappush(open_nodes, (-float((bounds[rows, child] - best.kth()[rows]).max()), child))
            continue
        at = tree.order[tree.start[node] : tree.stop[node]]
        scores = queries[rows] @ points[at].T
        scores[query_ids[rows][:, None] == ids[at][None, :]] = -np.inf
        best.add(rows, ids[at], scores)
    return best


def exact_search(queries: list, query_ids: np.ndarray, points: list, ids: np.ndarray, k: int) -> list[tuple]:
    """For components so large that doubles could round: Python's integers, the same order."""
    found = []
    for q, own in zip(queries, query_ids.tolist(), strict=True):
        scored = (
            (-sum(int(a) * int(b) for a, b in zip(q, p, strict=False)), i)
            for p, i in zip(points, ids.tolist(), strict=True)
            if i != own
        )
        found += [(own, i, min(max(-s, -LONG), LONG)) for s, i in heapq.nsmallest(k, scored)]
    return found


class Shard:
    """Points of one shard as they come in; the tree is built once, when the first queries follow."""

    def __init__(self, number: int):
        self.number = number
        self.parts: list[pd.DataFrame] = []
        self.tree: BallTree | None = None

    def add(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.parts.append(rows[["id", "v"]])

    def answer(self, asks: pd.DataFrame, k: int) -> pd.DataFrame:
        """``(query_id, id, score)`` of the k best points of each query."""
        names = ["query_id", "id", "score"]
        if not self.parts:
            return pd.DataFrame({c: [] for c in names}, dtype=np.int64)
        if self.tree is None:
            rows = pd.concat(self.parts)
            self.parts, self.ids, self.vectors = [rows], rows["id"].to_numpy(), rows["v"]
            self.tree = BallTree(padded(self.vectors))
            self.largest = float(np.abs(self.tree.points).max()) if self.tree.points.size else 0.0
        qid, width = asks["id"].to_numpy(), self.tree.points.shape[1]
        # Components of a query beyond the longest point meet only zeros.
        q = padded(asks["v"], width)
        largest = max(self.largest, float(np.abs(q).max()) if q.size else 0.0)
        if largest * largest * width >= EXACT:
            return pd.DataFrame(exact_search(list(asks["v"]), qid, list(self.vectors), self.ids, k), columns=names)
        best = search(self.tree, q, qid, self.ids, k, asks["floor"].to_numpy())
        row, col = np.nonzero(best.scores > -np.inf)
        return pd.DataFrame({"query_id": qid[row], "id": best.ids[row, col], "score": best.scores[row, col].astype(np.int64)})


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 1024.0,
    shard_rows: int = 8192,
    query_rows: int = 512,
) -> DataFrame:
    """``(query_id, rank, id_col, score)`` of the k rows of ``vectors`` with the largest integer inner products.

    Both inputs have ``id_col`` and ``vector_col``; components become floor(scale * x).
    """
    check_columns(vectors, [id_col, vector_col], [])
    check_columns(queries, [id_col, vector_col], [])
    ship(vectors.sparkSession)

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        ready = df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
        # A double of 2**53 and more is whole already, and may not fit a 64-bit number.
        y = F.transform(v, lambda x: x * scale)
        floors = F.transform(y, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
        return ready.select(F.col(id_col).cast("long").alias("id"), floors.alias("v"))

    points, asked = stored(whole(vectors), "points"), stored(whole(queries).distinct(), "queries")
    shards = max(1, -(-points.count() // shard_rows))
    points = points.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = None
        for rows in batches:
            for number, part in rows.groupby("shard", sort=True):
                if shard is None or shard.number != number:
                    shard = Shard(number)
                shard.add(part[~part["asks"]])
                asks = part[part["asks"]]
                for begin in range(0, len(asks), query_rows):
                    yield shard.answer(asks.iloc[begin : begin + query_rows], k)

    schema = "query_id long, id long, score long"

    def met(questions: DataFrame, first: int, last: int) -> DataFrame:
        """Shards ``first`` to ``last`` with all queries: a shard's points come first, then the queries in blocks."""
        some = points.where(F.col("shard").between(first, last))
        left = some.select("shard", F.lit(False).alias("asks"), "id", "v", F.lit(float("-inf")).alias("floor"))
        every_shard = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("shard")
        right = questions.select(every_shard, F.lit(True).alias("asks"), "id", "v", "floor")
        together = left.unionByName(right).withColumn("shard", F.col("shard").cast("int")).repartition("shard")
        return together.sortWithinPartitions("shard", "asks").mapInPandas(meet, schema)

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    unknown = F.lit(float("-inf"))
    found, first = None, 0
    while first < shards:
        last = min(shards, max(1, first * WAVE)) - 1
        if found is None:
            questions = asked.withColumn("floor", unknown)
        else:
            kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
            questions = asked.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", unknown))
        wave = met(questions, first, last)
        if found is not None:
            wave = found.drop("rank").unionByName(wave)
        found, first = stored(ranked(wave), "best"), last + 1
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
