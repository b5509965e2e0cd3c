import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from cases import TEXTS, no_documents, odd_documents

from notelattice.llm import near_copies
from notelattice.llm.components import merge


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_labels(texts):
    sets = [shingle_set(t) for t in texts]
    near = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if a == b or 5 * len(a & b) >= 4 * len(a | b)
    ]
    labels = np.arange(len(texts))
    if near:
        merge(labels, *np.array(near).T)
    return labels


def planted():
    """Unlike texts, near copies on both sides of 0.8, chains, a template with its own similarity below 0.8."""
    draw = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: list(draw.choice(vocabulary, n))
    out = []
    for n in (8, 30, 60, 120, 400):
        for _ in range(12):
            base = text(n)
            out.append(base)
            for share in (0.005, 0.01, 0.02, 0.03, 0.05):
                copy = list(base)
                for at in draw.integers(0, n, max(1, round(share * n))):
                    copy[at] = "changed"
                out.append(copy)
    chain = text(100)
    for _ in range(15):  # each near the next one, the ends unlike
        out.append(chain)
        chain = [*chain[6:], *text(6)]
    template = text(140)
    for _ in range(25):
        page = [*template, *text(40)]
        out += [page, [*page[:-1], "end"]]
    order = draw.permutation(len(out))
    return [" ".join(out[i]) for i in order]


@pytest.mark.parametrize("options", [{}, {"block_rows": 8}])
def test_groups_against_all_pairs(spark, options):
    texts = planted()
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, **options).collect()}
    assert got == dict(enumerate(brute_labels(texts).tolist()))


def test_stage_takes_near_copies_beyond_four_bits(spark):
    texts = planted()
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.simhash(spark, docs, "").collect())
    assert kept == sorted(set(brute_labels(texts).tolist()))


def test_odd_documents(spark):
    got = near_copies.near_copies(odd_documents(spark)).collect()
    labels, ids = brute_labels([t for _, t, *_ in TEXTS]), [i for i, *_ in TEXTS]
    first = {k: min((i for i, x in zip(ids, labels, strict=True) if x == k and i is not None), default=None) for k in set(labels)}
    want = [(i, first[k]) for i, k in zip(ids, labels, strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.component_id)) for r in got)
    assert near_copies.near_copies(no_documents(spark)).count() == 0


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = docs.select("doc_id", "text").collect()
    labels = brute_labels([r.text for r in rows])
    want = {r.doc_id: rows[k].doc_id for r, k in zip(rows, labels, strict=True)}
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want
