"""Search against SQLite's own full-text index with the trigram tokenizer."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from helpers import pages_df
from notelattice.operators import batch_search, search

COLUMNS = ["slug", "title", "compiled_truth", "timeline_text"]
QUERIES = [
    "alpha", "alpha beta", "to rust", "to AND rust", "to OR rust", "rust NOT to", "NOT rust", "alpha AND", "alpha OR beta AND gamma",
    "alpha NOT beta gamma", "alpha NOT beta AND gamma", "alpha AND gamma NOT beta", "foo_bar", "foo.bar", "测试记录", "测试", "试记录内",
    "alpha and beta", "alpha OR NOT beta", "al OR alpha", "alpha NOT al", "alpha AND al", "al alpha", "al NOT alpha", "it's", "alp*",
    "OR alpha", "aaa", "ana", "ALPHA", "beta NOT gamma OR rust", "x-y", "alpha-beta", "", "alpha alpha", "alpha OR alpha beta",
    "beta NOT gamma rust", "rust OR beta NOT alpha",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "rust", "to", "banana", "aaaa", "foo_bar", "测试记录内容", "x-y", "alpha-beta", "Alphabet"]
    out = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        out.append((f"wiki/{rng.choice(words[:6])}/{i}", " ".join(rng.choices(words, k=2)), text, rng.choice(words + [""])))
    return out


@pytest.fixture(scope="module")
def pages(spark, rows):
    data = [
        {"slug": s, "title": t, "compiled_truth": c, "page_type": "Concept" if i % 3 else "Source",
         "timeline": [("2024-01-01", None, tl, None)] if tl else []}
        for i, (s, t, c, tl) in enumerate(rows)
    ]
    return pages_df(spark, data).withColumn("updated_at", F.timestamp_seconds(F.length("compiled_truth"))).cache()


@pytest.fixture(scope="module")
def sqlite(rows):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(slug, title, compiled_truth, timeline_text, tokenize='trigram')")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", rows)
    return db


def expected(db, query, weights="10, 5, 1, 1"):
    text = search.clean_query(query)
    if not text:
        return {}
    try:
        return dict(db.execute(f"SELECT slug, bm25(f, {weights}) FROM f WHERE f MATCH ?", (text,)).fetchall())
    except sqlite3.OperationalError:
        return {}


@pytest.mark.parametrize("query", QUERIES)
def test_matches_sqlite(pages, sqlite, query):
    got = {r.slug: r["rank"] for r in search.ranked(pages, search.clean_query(query)).select("slug", "rank").collect()}
    want = expected(sqlite, query)
    assert got.keys() == want.keys()
    for slug, score in want.items():
        assert got[slug] == pytest.approx(score, rel=1e-9), slug


def test_sort_limit_and_filter(pages, rows):
    ranks = [r["rank"] for r in search.search(pages, "alpha", limit=100).collect()]
    assert ranks == sorted(ranks)
    titles = [r.title for r in search.search(pages, "alpha", limit=100, sort="title").collect()]
    assert titles == sorted(titles)
    everything = {r.slug: r["rank"] for r in search.search(pages, "alpha", limit=100).collect()}
    only = {r.slug: r["rank"] for r in search.search(pages, "alpha", limit=100, type_filter="Source").collect()}
    assert 0 < len(only) < len(everything)
    assert all(everything[s] == r for s, r in only.items())  # statistics stay global
    assert search.search(pages, "alpha").count() == 10
    assert search.search(pages, "alpha", limit=-5).count() == 0
    assert search.search(pages, "alpha", type_filter=" ").count() == 10
    long = {r.slug: r.preview for r in search.search(pages, "alpha", limit=100).collect()}
    assert all(p == dict((s, c) for s, _, c, _ in rows)[s][:200] for s, p in long.items())


def test_date_sort(pages):
    by_date = [r.slug for r in search.search(pages, "alpha", limit=100, sort="date").collect()]
    times = {r.slug: r.updated_at for r in pages.select("slug", "updated_at").collect()}
    assert [times[s] for s in by_date] == sorted((times[s] for s in by_date), reverse=True)


def test_invalid_query_can_raise(pages):
    with pytest.raises(search.QuerySyntaxError):
        search.search(pages, "alpha AND", on_invalid="raise")
    with pytest.raises(search.QuerySyntaxError):
        search.search(pages, "foo:bar", on_invalid="raise")


def test_unweighted_slugs(pages, sqlite):
    got = [r.slug for r in search.search_slugs(pages, "banana").collect()]
    want = expected(sqlite, "banana", "1, 1, 1, 1")
    assert sorted(got) == sorted(want)
    assert got == sorted(want, key=lambda s: (round(want[s], 12), s))


def test_stored_search_table(pages):
    table = search.search_table(pages).cache()
    direct = search.search(pages, "beta gamma", limit=50).collect()
    assert search.search(table, "beta gamma", limit=50).collect() == direct


@pytest.mark.parametrize("bound", [batch_search.TERM_BROADCAST_BYTES, 0])
def test_batch_equals_single(spark, pages, monkeypatch, bound):
    monkeypatch.setattr(batch_search, "TERM_BROADCAST_BYTES", bound)
    asked = {1: ["alpha"], 2: ["Alpha", "beta"], 3: ["aaa"], 4: ["nowhere"], 5: ["alpha", "nowhere"], 6: ["ana", "测试记"], 7: ["to", "rust"]}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    got = {}
    for r in batch_search.batch_search(pages, queries, limit=5).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.slug, round(r["rank"], 9)))
    for number, terms in asked.items():
        single = search.search(pages, " ".join(terms), limit=5).collect()
        assert got.get(number, []) == [(r.slug, round(r["rank"], 9)) for r in single], terms


def test_trigram_postings(spark):
    pages = pages_df(spark, [{"slug": "abcabc", "title": "ab", "compiled_truth": "aaaa测试记"}])
    got = {(r.trigram, r.column): r.tf for r in batch_search.trigram_postings(pages).collect()}
    assert got[("abc", "slug")] == 2 and got[("aaa", "compiled_truth")] == 2 and got[("测试记", "compiled_truth")] == 1
    assert not any(column == "title" for _, column in got)


def test_batch_terms_longer_than_a_window(spark):
    long = "x" * 10 + "abc" * 20
    pages = [{"slug": "a", "title": "t", "compiled_truth": f"one {long}q two {long}"}, {"slug": "b", "title": "t", "compiled_truth": long[:-1]}]
    queries = spark.createDataFrame([(1, [long]), (2, [long[:40], "one"]), (3, ["ab"])], "query_id long, terms array<string>")
    got = [(r.query_id, r.slug) for r in batch_search.batch_search(pages_df(spark, pages), queries).orderBy("query_id").collect()]
    assert got == [(1, "a"), (2, "a")]
    assert [(r.query_id, r.status) for r in batch_search.query_status(queries).collect()] == [(1, "searched"), (2, "searched"), (3, "no_terms")]
    hits = batch_search.term_hits(search.search_table(pages_df(spark, pages)), spark.createDataFrame([(long,), (long[:40],)], "term string"), (1.0,) * 4)
    assert sorted((r.slug, len(r.term), r.freq) for r in hits.collect()) == [("a", 40, 2.0), ("a", 70, 2.0), ("b", 40, 1.0)]


def test_trigrams_are_counted_as_numbers(spark, monkeypatch):
    """One pass without lists of trigram strings; many letters, letters beyond 16 bits and slices give the same."""
    texts = ["".join(chr(0x4E00 + (i * 37 + k) % 9000) for i in range(9000)) for k in range(40)] + ["a😀b😀a😀b", "ab", "", "x" * 50]
    monkeypatch.setattr(batch_search, "SLICE_CHARS", 1 << 20)
    _, count, spell = batch_search.counter()
    text, trigram, times, alphabet = count(texts)
    got = dict(zip(zip(text.tolist(), spell(trigram, alphabet).to_pylist()), times.tolist()))
    want = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 2):
            want[k, t[i : i + 3]] = want.get((k, t[i : i + 3]), 0) + 1
    assert got == want
    pages = pages_df(spark, [{"slug": str(k), "compiled_truth": t} for k, t in enumerate(texts[-6:])])
    found = batch_search.trigram_postings(pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan
    monkeypatch.setattr(batch_search, "SLICE_CHARS", 5)
    assert sorted(found.collect()) == sorted(batch_search.trigram_postings(pages).collect())


def test_batch_terms_are_found_in_one_pass(spark, monkeypatch):
    """No window per position, no shuffled hit: one pass counts all terms as the joins do, whatever the letters."""
    texts = ["aaaa", "ab\0ab\0ab", "a😀b😀a😀b", "测试记测试记", "", "xyz" * 200, "ends with ab", "\0abc"]
    pages = pages_df(spark, [{"slug": f"p/{k}", "title": t[:4], "compiled_truth": t} for k, t in enumerate(texts)])
    terms = ["aaa", "aa", "ab\0", "b\0ab", "😀a😀", "测试记", "xyzxyz", "xyz" * 30, "xyz" * 1000, "p/1", " ab", "abc", "nowhere"]
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    table = search.search_table(pages)
    found = batch_search.term_hits(table, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan and "Exchange" not in plan
    got = sorted((r.slug, r.n_tokens, r.term, r.freq) for r in found.collect())
    monkeypatch.setattr(batch_search, "TERM_TREE_BYTES", 0)
    assert got == sorted((r.slug, r.n_tokens, r.term, r.freq) for r in batch_search.term_hits(table, asked).collect())
    want = {}
    for k, t in enumerate(texts):
        for column, weight in ((f"p/{k}", 10.0), (t[:4], 5.0), (t, 1.0)):
            for term in terms:
                if len(term) >= 3 and (n := sum(column.startswith(term, i) for i in range(len(column)))):
                    want[f"p/{k}", term] = want.get((f"p/{k}", term), 0) + weight * n
    assert {(slug, term): freq for slug, _, term, freq in got} == want
