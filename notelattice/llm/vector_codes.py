"""Product quantisation of vectors, with distance bounds that skip most comparisons.

Components become whole numbers, ``floor(scale * x)``, and vectors are cut into equal parts; every part position has a
codebook of its own, learned by rounds of assignment and componentwise floored means. All sums and distances are whole
numbers, so any order of the rows gives the same codebooks.

Assignment keeps, for every part of every vector, its entry with an upper bound of the distance, its ``b`` next closest
entries with ordered lower bounds, and one outer bound for all entries beyond. When the entries of a codebook have moved,
bounds give way by the distances moved. A part whose upper bound stays below all lower bounds keeps its entry unseen.
Else the upper bound is made exact; and if that is not enough, only the entries whose bounds reach below it are measured,
or all if the outer bound does. Bounds are floats rounded outward; what they leave open is decided by whole-number
distances, ties to the lower index. After each round ``b`` is set from how deep the rounds had to look.

A round is one pass over the stored vectors and bounds: it writes them anew together with each task's sums for the next
codebook (``parts x entries`` rows, added up by Spark), and the table of the round before is removed once the next is
whole. The driver holds codebooks only.

Defined cases: rows whose vector is null or empty or holds null or non-finite components are left out, and so are vectors
of another length than that of the smallest id. Repeated ids are coded each; of those only one, with the smallest
vector, can start a codebook; null ids count as the largest. Fewer ids than entries give smaller codebooks. No rows give
no codes. Components whose whole number doesn't fit the 64-bit distances (beyond 2**28 for parts of 8) are an error.
Only the columns in ``keep`` are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.llm.common import check_columns, discard, ship, stored, stored_at
from notelattice.operators.skew import if_small

NONE = 255  # a place in the list of close entries that is not filled; its bound is the outer one
BLOCK = 8192  # vectors assigned at once
STATE = ["_vector", "_state", "_sums"]


@dataclass
class Codes:
    rows: DataFrame  # the columns to keep, code (hex, two digits a part), error
    codebooks: list[list[list[int]]]  # part, entry, component

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and position."""
        flat = ",".join(str(x) for book in self.codebooks for entry in book for x in entry)
        return hashlib.sha256(flat.encode()).hexdigest()


def _down(x: np.ndarray) -> np.ndarray:
    """As float32, not above ``x``."""
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


@dataclass
class Bounds:
    """What is known of parts (one row each): entry, close entries, and the bounds of their distances."""

    near: np.ndarray  # uint8 (rows, 1 + b): the entry, then the close ones in the order of their lower bounds
    upper: np.ndarray  # float32 (rows)
    lower: np.ndarray  # float32 (rows, b + 1): of the close entries, at last of all others

    @property
    def b(self) -> int:
        return self.near.shape[1] - 1

    def resized(self, b: int) -> Bounds:
        """Fewer close entries give their bounds to the outer one; more are not filled yet."""
        if b <= self.b:
            # Ordered, so the first bound dropped is the smallest of them.
            return Bounds(self.near[:, : 1 + b], self.upper, self.lower[:, : b + 1])
        extra = b - self.b
        near = np.hstack([self.near, np.full((len(self.near), extra), NONE, np.uint8)])
        return Bounds(near, self.upper, np.hstack([self.lower, np.repeat(self.lower[:, -1:], extra, axis=1)]))

    def packed(self, parts: int) -> list[bytes]:
        n = len(self.near) // parts
        floats = np.hstack([self.upper[:, None], self.lower]).astype("<f4").reshape(n, -1).view(np.uint8)
        return [row.tobytes() for row in np.hstack([self.near.reshape(n, -1), floats])]

    @staticmethod
    def unpacked(rows: list[bytes], parts: int, b: int) -> Bounds:
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), parts * (1 + b + 4 * (b + 2)))
        near = raw[:, : parts * (1 + b)].reshape(-1, 1 + b)
        floats = np.ascontiguousarray(raw[:, parts * (1 + b) :]).view("<f4").reshape(-1, b + 2)
        return Bounds(near, floats[:, 0], floats[:, 1:])


def _squares(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows, candidates) of parts (rows, size) to entries (rows or 1, candidates, size)."""
    apart = values[:, None, :] - entries
    return np.einsum("ijk,ijk->ij", apart, apart)


def _ordered(ids: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of each row by distance, then index."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    squares = np.take_along_axis(squares, by_id, 1)
    by_distance = np.argsort(squares, axis=1, kind="stable")
    ids = np.take_along_axis(np.take_along_axis(ids, by_id, 1), by_distance, 1)
    return ids, np.take_along_axis(squares, by_distance, 1)


def _measure_all(values: np.ndarray, part: np.ndarray, books: np.ndarray, b: int) -> Bounds:
    k = books.shape[1]
    squares = np.empty((len(values), k), np.int64)
    for p in range(len(books)):
        rows = part == p
        squares[rows] = _squares(values[rows], books[p][None])
    ids, squares = _ordered(np.broadcast_to(np.arange(k, dtype=np.uint8), squares.shape), squares)
    distances = np.sqrt(squares.astype(np.float64))
    near = np.full((len(values), 1 + b), NONE, np.uint8)
    lower = np.full((len(values), b + 1), np.inf, np.float32)
    filled = min(k, 1 + b)
    near[:, :filled] = ids[:, :filled]
    reached = min(k - 1, b + 1)
    lower[:, :reached] = _down(distances[:, 1 : 1 + reached])
    return Bounds(near, _up(distances[:, 0]), lower)


def assign(
    values: np.ndarray, part: np.ndarray, books: np.ndarray, moved: np.ndarray | None, known: Bounds | None, b: int
) -> tuple[Bounds, np.ndarray]:
    """New bounds, and how many parts were settled at each depth: unseen, upper bound, 1 to b entries, all.

    ``values``: parts (rows, size); ``part``: their positions; ``moved``: how far each entry went since ``known``.
    """
    if known is None or moved is None:
        found = _measure_all(values, part, books, b)
        counts = np.zeros(b + 3, np.int64)
        counts[-1] = len(values)
        return found, counts
    known = known.resized(b)
    near, counts = known.near.copy(), np.zeros(b + 3, np.int64)
    upper = known.upper + moved[part, near[:, 0]]
    slack = np.empty((len(values), b + 1))
    farthest = moved.max(axis=1)[part]
    for i in range(b):
        close = near[:, 1 + i]
        slack[:, i] = np.where(close == NONE, farthest, moved[part, np.where(close == NONE, 0, close)])
    slack[:, b] = farthest
    # From the right, so that each bound holds for all entries from its place on.
    lower = np.minimum.accumulate((known.lower - slack)[:, ::-1], axis=1)[:, ::-1]
    upper, lower = _up(upper), _down(lower)

    unsure = np.flatnonzero(upper >= lower[:, 0])
    counts[0] = len(values) - len(unsure)
    own = _squares(values[unsure], books[part[unsure], near[unsure, 0]][:, None])[:, 0]
    upper[unsure] = _up(np.sqrt(own.astype(np.float64)))
    still = upper[unsure] >= lower[unsure, 0]
    counts[1] = len(unsure) - int(still.sum())
    unsure, own = unsure[still], own[still]
    # The first place whose bound is out of reach: entries before it have to be measured.
    depth = (upper[unsure, None] >= lower[unsure]).sum(axis=1)
    for d in range(1, b + 1):
        rows, mine = unsure[depth == d], own[depth == d]
        counts[1 + d] += len(rows)
        if not len(rows):
            continue
        ids = near[rows, : 1 + d]
        empty = ids == NONE
        squares = np.empty(ids.shape, np.int64)
        squares[:, 0] = mine
        entries = books[part[rows][:, None], np.where(empty, 0, ids)[:, 1:]]
        squares[:, 1:] = _squares(values[rows], entries)
        squares[empty] = np.iinfo(np.int64).max
        ids, squares = _ordered(ids, squares)
        near[rows, : 1 + d] = ids
        distances = np.sqrt(squares.astype(np.float64))
        upper[rows] = _up(distances[:, 0])
        # Places that aren't filled, now last, and those beyond the depth keep what held for all beyond it.
        beyond = lower[rows, d]
        measured = np.where(ids[:, 1:] == NONE, beyond[:, None], _down(distances[:, 1:]))
        lower[rows, :d] = np.minimum(measured, beyond[:, None])
    rest = unsure[depth > b]
    counts[b + 2] = len(rest)
    if len(rest):
        found = _measure_all(values[rest], part[rest], books, b)
        near[rest], upper[rest], lower[rest] = found.near, found.upper, found.lower
    return Bounds(near, upper, lower), counts


def adapted(b: int, k: int, counts: list[int]) -> int:
    """``b`` for the next round: an entry more if many parts had to measure all, else as deep as one in 1000 went."""
    total, everything = max(1, sum(counts)), counts[-1]
    if everything * 20 > total:
        return min(b + 1, max(1, k // 2))
    used = [d for d in range(1, b + 1) if counts[1 + d] * 1000 > total]
    return max(1, k // 8, max(used, default=1))


def _usable(vector_col: str) -> Column:
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def _seeds(rows: DataFrame, entries: int) -> list[list[float]]:
    """Vectors of the smallest ids, one per id; in few scans however often ids are repeated."""
    found: dict[object, list[float]] = {}
    left = rows
    while len(found) < entries:
        got = left.orderBy(F.asc_nulls_last("_seed"), "_vector").limit(entries).collect()
        for r in got:
            if r["_seed"] not in found and len(found) < entries:
                found[r["_seed"]] = r["_vector"]
        if len(got) < entries or got[-1]["_seed"] is None:
            break
        left = rows.where((F.col("_seed") > got[-1]["_seed"]) | F.col("_seed").isNull())
    return list(found.values())


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    keep: tuple[str, ...] = ("vec_id", "label"),
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> Codes:
    """Codes of all usable vectors and the codebooks after ``rounds`` rounds."""
    if not 0 < entries <= NONE or parts < 1:
        raise ValueError("codes are bytes below 255")
    check_columns(vectors, [id_col, vector_col, *keep], ["code", "error"])
    spark = vectors.sparkSession
    ship(spark)
    kept = vectors.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
                          F.col(id_col).alias("_seed"), F.col(vector_col).cast("array<double>").alias("_vector")).where(_usable("_vector"))
    seeds = _seeds(kept.select("_seed", "_vector"), entries)
    carried = [f"_k{i}" for i in range(len(keep))]
    names = [F.col(k).alias(c) for k, c in zip(carried, keep, strict=True)]
    if not seeds:
        empty = kept.select(*names, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return Codes(empty.limit(0), [])
    width = len(seeds[0])
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    size, limit = width // parts, int(np.sqrt(2**61 / (4 * (width // parts))))
    seeds = [s for s in seeds if len(s) == width]
    kept = kept.where(F.size("_vector") == width).drop("_seed")

    def whole(values: np.ndarray) -> np.ndarray:
        values = np.floor(values * scale)
        if len(values) and np.abs(values).max() > limit:
            raise ValueError(f"components beyond {limit} / {scale} have no exact 64-bit distances")
        return values.astype(np.int64)

    books = whole(np.array(seeds)).reshape(len(seeds), parts, size).transpose(1, 0, 2)
    k = books.shape[1]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*carried).schema)
    schema = f"{types}, _vector binary, _state binary, _sums array<long>" if carried else "_vector binary, _state binary, _sums array<long>"

    def pass_over(books: np.ndarray, moved: np.ndarray | None, b_before: int | None, b: int):
        position = np.tile(np.arange(parts), BLOCK)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts, k, size + 1), np.int64)
            depths = np.zeros(b + 3, np.int64)
            like = None
            for batch in batches:
                like = batch.schema if like is None else like
                for at in range(0, batch.num_rows, BLOCK):
                    piece = batch.slice(at, BLOCK)
                    column = piece.column("_vector")
                    if b_before is None:
                        flat = column.flatten().to_numpy(zero_copy_only=False)
                        ints = whole(flat).reshape(-1, size)
                        known = None
                    else:
                        ints = np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(-1, size)
                        known = Bounds.unpacked(piece.column("_state").to_pylist(), parts, b_before)
                    part = position[: len(ints)]
                    found, counts = assign(ints, part, books, moved, known, b)
                    depths += counts
                    place = part * k + found.near[:, 0]
                    for c in range(size):
                        _add(sums, c, place, ints[:, c])
                    sums[:, :, size] += np.bincount(place, minlength=parts * k).reshape(parts, k)
                    data = ints.astype("<i4").reshape(piece.num_rows, width)
                    columns = [
                        *(piece.column(c) for c in carried),
                        pa.array([row.tobytes() for row in data], pa.binary()),
                        pa.array(found.packed(parts), pa.binary()),
                        pa.nulls(piece.num_rows, pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[*carried, *STATE])
            if like is not None:
                flat = np.concatenate([sums.ravel(), depths])
                columns = [
                    *(pa.nulls(1, like.field(c).type) for c in carried),
                    pa.nulls(1, pa.binary()),
                    pa.nulls(1, pa.binary()),
                    pa.array([flat], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, *STATE])

        return run

    b_before, b, moved = None, max(1, min(k - 1, k // 4)), None
    table, at = kept.select(*carried, "_vector"), None
    for _ in range(rounds):
        following, path = stored_at(table.mapInArrow(pass_over(books, moved, b_before, b), schema), "vector-codes")
        if at:
            discard(spark, at)
        table, at = following.where("_sums is null").select(*carried, "_vector", "_state"), path
        gathered = following.where("_sums is not null").select(F.posexplode("_sums").alias("i", "v"))
        flat = np.zeros(parts * k * (size + 1) + b + 3, object)
        for r in gathered.groupBy("i").agg(F.sum("v").alias("v")).collect():
            flat[r["i"]] = r["v"]
        sums = flat[: parts * k * (size + 1)].reshape(parts, k, size + 1)
        renewed = books.copy()
        for p in range(parts):
            for e in range(k):
                if sums[p, e, size]:
                    renewed[p, e] = [int(s) // int(sums[p, e, size]) for s in sums[p, e, :size]]
        steps = (renewed - books).astype(np.float64)
        moved = np.nextafter(np.sqrt((steps * steps).sum(axis=2)), np.inf)
        moved[(renewed == books).all(axis=2)] = 0.0
        b_before, b = b, adapted(b, k, [int(x) for x in flat[parts * k * (size + 1) :]])
        books = renewed
    last = _last_pass(books, moved, b_before, b, carried, parts, size, whole)
    coded = table.mapInArrow(last, f"{types}, code string, error long" if carried else "code string, error long")
    return Codes(coded.select(*names, "code", "error"), books.tolist())


def _add(sums: np.ndarray, component: int, place: np.ndarray, values: np.ndarray) -> None:
    """Add values to the sums of their places, exactly: in two halves, whose float sums stay whole."""
    n = sums.shape[0] * sums.shape[1]
    high, low = values >> 16, values & 0xFFFF
    total = np.bincount(place, high, n).astype(np.int64) * 65536 + np.bincount(place, low, n).astype(np.int64)
    sums[:, :, component] += total.reshape(sums.shape[:2])


def _last_pass(books, moved, b_before, b, carried, parts, size, whole):
    position = np.tile(np.arange(parts), BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                column = piece.column("_vector")
                known = None
                if b_before is None:
                    ints = whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)
                else:
                    ints = np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(-1, size)
                    known = Bounds.unpacked(piece.column("_state").to_pylist(), parts, b_before)
                part = position[: len(ints)]
                found, _ = assign(ints, part, books, moved, known, b)
                entry = found.near[:, 0]
                squares = _squares(ints, books[part, entry][:, None])[:, 0].reshape(-1, parts).sum(axis=1)
                codes = [row.tobytes().hex() for row in np.ascontiguousarray(entry.reshape(-1, parts))]
                columns = [*(piece.column(c) for c in carried), pa.array(codes, pa.string()), pa.array(squares, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, "code", "error"])

    return run


def with_label_error(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """``rows`` with ``label_error``, the errors summed over equal labels, nulls together.

    Sums combine before the shuffle; their table is broadcast up to a measured size.
    """
    rows = stored(rows, "codes")
    sums = stored(
        rows.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors"
    )
    return rows.join(if_small(sums), F.col(label_col).eqNullSafe(F.col("_label")), "left").drop("_label")
