"""Fill-in-middle against plain regular expressions; the learned index against the numbers themselves."""

import hashlib
import re

import numpy as np
import pytest
from cases import LONG, no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st

from notelattice.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(row_id, text, seed=42):
    units = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x1f\x85 aé日\U0001f600<P>", max_size=40), min_size=1, max_size=5), st.integers(1, 9))
def test_unit_ends(texts, chunk):
    ends = np.cumsum([len(t) for t in texts])
    want, at = [], 0
    for t in texts:
        want += [at + m.end() for m in UNITS.finditer(t)]
        at += len(t)
    got = np.concatenate([np.zeros(0, int), *fim.unit_ends("".join(texts), ends, chunk)])
    assert got.tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5000), max_size=300), max_size=4), st.sampled_from([1, 7, 100]))
def test_rank_index_is_exact(steps, bound):
    index, all_values, last = fim.RankIndex(bound), [], 0
    for part in steps:
        values = last + np.cumsum(np.array(part, np.int64))
        last = int(values[-1]) if len(values) else last
        index.extend(values)
        all_values += values.tolist()
    assert index.at(np.arange(len(all_values))).tolist() == all_values
    assert all(len(r) == 0 or abs(r.astype(int)).max() <= bound + 1 for r in index._residuals)


def test_rank_index_is_small():
    rng = np.random.default_rng(1)
    index = fim.RankIndex()
    index.extend(np.cumsum(rng.integers(2, 12, 1_000_000)))
    assert index.n_segments < 3000 and index._residuals[0].dtype == np.int8


@pytest.mark.parametrize("batch_bytes", [1, 1 << 20])
def test_equals_brute_force(spark, batch_bytes):
    hostile = "<P> a <S> b"
    rows = [(i, t) for i, t in enumerate([LONG, "", None, hostile, "one", "  ", "< P> <S <M", "a b\n\nc d  e"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.fill_in_middle(docs, batch_bytes=batch_bytes).withColumn("back", fim.restored()).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, text)
        assert r.back == text
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = fim.fill_in_middle(docs, keep=("doc_id", "source", "group")).collect()
    want = sorted((repr((r.doc_id, *expected(r.doc_id, r.text or ""))) for r in docs.collect()))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == want
    assert fim.fill_in_middle(no_documents(spark)).collect() == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs.withColumn("form", docs.text), keep=("form",))
