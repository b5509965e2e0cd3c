"""Vector codes against plain Lloyd rounds in Python numbers; bounds against measured distances."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelattice.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def nearest(v, book):
    return min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v, book[e], strict=True)), e))


def brute(rows, parts, entries, rounds, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows]
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    seeds, seen = [], set()
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if i not in seen and len(seeds) < entries:
            seen.add(i)
            seeds.append(v)
    books = [[cut(v, p) for v in seeds] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(nearest(cut(v, p), books[p]), []).append(cut(v, p))
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else b for e, b in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        code = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum((a - b) ** 2 for p in range(parts) for a, b in zip(cut(v, p), books[p][code[p]], strict=True))
        out.append((i, "".join(f"{c:02x}" for c in code), error, lab))
    return out, books


def rows_of(spark, rows, **options):
    made = vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    return sorted((tuple(r) for r in made.rows.select("vec_id", "code", "error", "label").collect()), key=repr), made


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties"])
def test_equals_lloyd(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "spread":
        v = rng.normal(size=(300, 8))
    elif kind == "clustered":
        v = rng.normal(size=(6, 8))[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) / 50
    else:
        v = rng.integers(-2, 3, size=(300, 8)) / 4096
    rows = [(int(i), [float(x) for x in np.float32(r)], int(i) % 3) for i, r in enumerate(v)]
    rows[7] = (7, rows[7][1], None)
    for rounds in (0, 1, 4):
        want, books = brute(rows, 4, 9, rounds)
        got, made = rows_of(spark, rows, parts=4, entries=9, rounds=rounds)
        assert got == sorted(want, key=repr)
        assert made.codebooks == books
        assert made.digest() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("b", [1, 2, 4])
def test_bounds_hold(b):
    """Entries move again and again; every assignment is right and every bound is one."""
    rng = np.random.default_rng(b)
    parts, k, size, n = 3, 12, 4, 900
    values = rng.integers(-500, 500, (n * parts, size))
    values[: n // 2] //= 200
    part = np.tile(np.arange(parts), n)
    books = rng.integers(-500, 500, (parts, k, size))
    known, moved, total = None, None, np.zeros(b + 3, int)
    for step in range(12):
        known, counts = vc.assign(values, part, books, moved, known, b)
        known = vc.Bounds.unpacked(known.packed(parts), parts, b)
        squares = ((values[:, None] - books[part]) ** 2).sum(axis=2)
        assert (known.near[:, 0] == squares.argmin(axis=1)).all()
        distances = np.sqrt(squares)
        rows = np.arange(len(values))
        assert (known.upper >= distances[rows, known.near[:, 0]]).all()
        rest = distances.copy()
        rest[rows, known.near[:, 0]] = np.inf
        for i in range(b + 1):
            assert (known.lower[:, i] <= rest.min(axis=1)).all()
            if i < b:
                there = known.near[:, 1 + i] != vc.NONE
                rest[rows[there], known.near[there, 1 + i]] = np.inf
        total += counts if step else 0
        following = books + rng.integers(-30, 31, books.shape) * (step % 3 == 0) // (1 + step)
        moved = np.nextafter(np.sqrt(((following - books) ** 2).sum(axis=2).astype(float)), np.inf)
        books = following
    assert total[0] > total[-1] and total[1:].sum()


def test_width_of_bounds_changes():
    rng = np.random.default_rng(9)
    values, part = rng.integers(-99, 99, (400, 4)), np.tile(np.arange(2), 200)
    books = rng.integers(-99, 99, (2, 16, 4))
    known, _ = vc.assign(values, part, books, None, None, 4)
    for b in (4, 2, 5, 1, 8):
        following = books + rng.integers(-6, 7, books.shape)
        moved = np.nextafter(np.sqrt(((following - books) ** 2).sum(axis=2).astype(float)), np.inf)
        books = following
        known, _ = vc.assign(values, part, books, moved, known, b)
        assert known.b == b
        assert (known.near[:, 0] == ((values[:, None] - books[part]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert vc.adapted(4, 16, [100, 0, 0, 0, 0, 0, 900]) == 5
    assert vc.adapted(4, 16, [900, 50, 50, 0, 0, 0, 0]) == 2


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0, 2.0]
    rows = [(1, v, 0), (1, [0.0] * 4, 0), (2, None, 0), (3, [1.0, None, 0.0, 0.0], 1), (4, [math.nan, 0.0, 0.0, 0.0], 1),
            (5, [math.inf, 0.0, 0.0, 0.0], 1), (6, v, None), (6, v, None), (None, [9.0] * 4, None), (7, [], 0), (8, [1.0], 0)]
    usable = [r for r in rows if r[0] in (1, 6, None)]
    got, made = rows_of(spark, rows, parts=2, entries=16, rounds=3)
    want, books = brute(usable, 2, 16, 3)
    assert got == sorted(want, key=repr) and made.codebooks == books and len(books[0]) == 3
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _vector", "2 as _state", "3 as _k0", "'x' as `a b`", "4 as _label")
    made = vc.compress(extra, keep=("vec_id", "label", "_vector", "_k0", "a b", "_state"), parts=2, rounds=1)
    totals = vc.with_label_error(made.rows).select("vec_id", "label", "error", "label_error", "_vector", "a b").collect()
    assert len(totals) == 5 and {(r["_vector"], r["a b"]) for r in totals} == {(1, "x")}
    for r in totals:
        assert r.label_error == sum(t.error for t in totals if t.label == r.label)
    nothing = vc.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert nothing.rows.collect() == [] and nothing.rows.columns == ["vec_id", "label", "code", "error"]
    assert vc.with_label_error(nothing.rows).collect() == []
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [1.0] * 3, 1)], SCHEMA), parts=2)
    with pytest.raises(Exception, match="64-bit"):
        vc.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], SCHEMA), parts=2)


def test_many_copies_of_small_ids(spark):
    rows = spark.range(1000).select((F.col("id") % 5).alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(0.0).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    made = vc.compress(rows, parts=1, entries=4, rounds=0)
    assert made.codebooks == [[[0, 0], [4096, 0], [8192, 0], [12288, 0]]]
