import math

import numpy as np
import pytest

from notelattice.llm import topk
from notelattice.llm.topk import top_k


def brute(rows, queries, k):
    ready = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in dict((i, v) for i, v in ready if i in queries).items():
        scored = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in ready if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    held = 2**63 - 1  # scores beyond 64 bits are held to them
    return sorted((q, n, i, max(-held, min(held, s))) for q, n, i, s in out)


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(4)
    found = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(900)]
    found += [(900 + i, found[i % 7][1]) for i in range(60)]  # ties
    return found + [(960, None), (961, [None] * 6), (962, [float("nan")] * 6), (963, [float("inf")] * 6), (964, []), (965, [0.5])]


@pytest.mark.parametrize("sizes", [(8192, 512), (100, 16), (64, 3)])
def test_against_brute_force(spark, rows, sizes):
    df = make(spark, rows)
    got = top_k(df, df.where("vec_id % 50 = 0 or vec_id >= 960"), k=10, shard_rows=sizes[0], query_rows=sizes[1])
    queries = {i for i, _ in rows if i % 50 == 0 or i >= 960}
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 10)


def test_kth_scores_go_from_wave_to_wave(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "WAVE", 2)
    df = make(spark, rows)
    got = top_k(df, df.where("vec_id % 100 = 0"), k=3, shard_rows=100, query_rows=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, {i for i, _ in rows if i % 100 == 0}, 3)


def test_few_rows_and_huge_components(spark):
    rows = [(0, [1e9, -1e9]), (1, [3e8 + 0.1, 2e8]), (2, [1e-9, 5.0])]
    df = make(spark, rows)
    assert sorted(map(tuple, top_k(df, df, k=10).collect())) == brute(rows, {0, 1, 2}, 10)


def test_no_rows(spark):
    df = make(spark, [])
    assert top_k(df, df).count() == 0
    some = make(spark, [(1, [1.0])])
    assert top_k(some, some).count() == 0
