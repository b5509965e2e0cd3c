import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from cases import TEXTS, no_documents, odd_documents

from notelattice.llm import embedding_dedup, simhash
from notelattice.llm.components import components, merge


def groups_of(pairs):
    found = {}
    for node, root in pairs:
        found.setdefault(root, set()).add(node)
    return sorted(map(sorted, found.values()))


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    edges += [(7, 7), (300, 301), (300, 301)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert groups_of(got) == [list(range(41)), list(range(100, 140)), [200, 201, 202], [300, 301]]
    assert all(r.root <= r.node for r in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, near):
    labels = np.arange(len(values))
    merge(labels, *np.nonzero(near))
    return labels


def test_fingerprints_of_odd_documents(spark):
    got = simhash.near_duplicates(odd_documents(spark)).collect()
    values = [brute_fingerprint(t) for _, t, *_ in TEXTS]
    bits = np.array(values, np.uint64)
    labels = brute_groups(values, np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4)
    ids = [i for i, *_ in TEXTS]
    first = {k: min((i for i, x in zip(ids, labels, strict=True) if x == k and i is not None), default=None) for k in set(labels)}
    want = [(i, f"{v:016x}", first[k]) for i, v, k in zip(ids, values, labels, strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got)
    kept = simhash.one_of_each(simhash.near_duplicates(odd_documents(spark), keep=("doc_id", "text"))).collect()
    assert len(kept) == len(set(labels))
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


@pytest.fixture(scope="module")
def fingerprints():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 200, dtype=np.uint64)
    values = set(base.tolist()) | {0, 1, 3}
    for b in base[:80].tolist():
        for _ in range(4):
            for k in draw.integers(0, 64, draw.integers(1, 5)):
                b ^= 1 << int(k)
            values.add(b)
    return np.array(sorted(values), np.uint64)


@pytest.mark.parametrize(
    "options",
    [{}, {"blocks": 6, "shard_rows": 8}, {"blocks": 3, "shard_rows": 8}, {"shard_rows": 16, "block_rows": 8}],
)
def test_links_are_exact_for_any_trees(spark, fingerprints, options):
    values = fingerprints.view(np.int64)
    labels = brute_groups(values, np.bitwise_count(fingerprints[:, None] ^ fingerprints[None, :]) <= 4)
    want = [g for g in groups_of(zip(values.tolist(), labels.tolist(), strict=True)) if len(g) > 1]
    nodes = spark.createDataFrame(pd.DataFrame({"fp": values}))
    assert groups_of(components(simhash.linked(nodes, **options)).collect()) == want


def test_bands_hold_every_pair():
    draw = np.random.default_rng(2)
    for blocks in (2, 3, 5, 6, 8):
        masks = simhash.bands(blocks, 4)
        for _ in range(200):
            d = sum({1 << int(k) for k in draw.integers(0, 64, 4)})
            assert any((d & m).bit_count() <= r for m, r in masks)


def vectors():
    draw = np.random.default_rng(5)
    rows = []
    for i in range(260):
        v = draw.normal(size=8)
        rows.append([v, i % 3])
        if i % 4 == 0:
            rows.append([v + draw.normal(size=8) * 0.07, i % 3])
        if i % 13 == 0:
            rows += [[v * 3, i % 3], [v, i % 3], [v, (i + 1) % 3]]
    rows += [[np.zeros(8), 0], [draw.normal(size=5), 0], [np.array([]), 0], [np.array([1e200] + [0.0] * 7), 1]]
    rows += [[np.array([2e200] + [0.0] * 7), 1], [np.array([1.0] + [0.0] * 7), 1]]
    out = [(i, [float(x) for x in v], label) for i, (v, label) in enumerate(rows)]
    out += [(len(out), None, 0), (len(out) + 1, [None] * 8, 0), (len(out) + 2, [float("nan")] * 8, 0)]
    out += [(len(out), [float("inf")] * 8, 0), (len(out) + 1, out[0][1], None), (0, out[0][1], 0)]
    return out


@pytest.mark.parametrize("options", [{}, {"block_rows": 16}, {"per_group": 1}, {"max_pivots": 2}])
def test_range_join_against_all_pairs(spark, options):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, links int")
    got = embedding_dedup.near_duplicates(df, **options).collect()
    good = [
        v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for _, v, label in rows
    ]
    near = np.zeros((len(rows), len(rows)), bool)
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            if i != j and good[i] and good[j] and label == other and len(v) == len(w):
                a, b = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
                near[i, j] = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98
    labels = brute_groups(rows, near)
    first = {k: min(r[0] for r, x in zip(rows, labels, strict=True) if x == k) for k in set(labels)}
    want = [(r[0], int(near[i].sum()), first[labels[i]], r[0] == first[labels[i]]) for i, r in enumerate(rows)]
    assert sorted(want) == sorted(map(tuple, got))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_scaled_copies_visit_every_pivot_of_their_direction(seed):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=64)
    rows = (base[None, :] * draw.uniform(0.1, 10, 3000)[:, None]).astype(np.float32).astype(np.float64)
    x = embedding_dedup.units(rows)
    pivots = embedding_dedup.Pivots(x[:7], float(np.sqrt(2 - 2 * 0.98)))
    d, home = pivots.homes(x)
    radius = np.zeros(7)
    np.maximum.at(radius, home, d[np.arange(len(x)), home])
    row, cell, _ = pivots.visits(x, radius)
    there = np.zeros((len(x), 7), bool)
    there[row, cell] = True
    assert there[:, np.unique(home)].all()  # all are within the range of each other
