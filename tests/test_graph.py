import random

import pytest

from helpers import links_df, pages_df
from pyspark.sql import functions as F

from notelattice.operators import graph as G
from notelattice.operators import lookup as L
from notelattice.operators import skew


def reach(links, slug, **options):
    return {r.slug: r.distance for r in G.neighbors(links, slug, **options).collect()}


def test_cycle_depth_direction_type(spark):
    links = links_df(spark, [("a", "b", "plain"), ("b", "c", "cites"), ("c", "a", "plain"), ("d", "b", "plain"), ("a", "b", "cites")])
    assert reach(links, "a") == {"b": 1}
    assert reach(links, "a", depth=9) == {"b": 1, "c": 2}
    assert reach(links, "a", depth=0) == {}
    assert reach(links, "b", depth=2, direction="in") == {"a": 1, "d": 1, "c": 2}
    assert reach(links, "a", direction="both") == {"b": 1, "c": 1}
    assert reach(links, "a", depth=3, link_type="plain") == {"b": 1}
    with pytest.raises(ValueError):
        G.neighbors(links, "a", direction="up")


@pytest.mark.parametrize("bound", [G.FRONTIER_BROADCAST_ROWS, 0])
def test_many_starts_against_plain_bfs(spark, monkeypatch, bound):
    monkeypatch.setattr(G, "FRONTIER_BROADCAST_ROWS", bound)
    rng = random.Random(3)
    edges = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)} | {("hub", f"n{i}") for i in range(60)}
    links = links_df(spark, [(a, b, "plain") for a, b in edges])
    starts = spark.createDataFrame([("hub",), ("n1",), ("n2",)], "slug string")
    got = {(r.start, r.slug): r.distance for r in G.neighbors_of(links, starts, depth=3).collect()}
    want = {}
    for start in ("hub", "n1", "n2"):
        seen, layer = {start}, {start}
        for distance in (1, 2, 3):
            layer = {b for a, b in edges if a in layer} - seen
            seen |= layer
            want |= {(start, x): distance for x in layer}
    assert got == want


def test_links_views_and_sharing(spark):
    links = links_df(spark, [("a", "x", "plain"), ("a", "y", "cites"), ("b", "x", "cites"), ("b", "z", "plain"), ("x", "a", "plain")])
    pages = pages_df(spark, [{"slug": s} for s in "abxyq"])
    assert {r.target_slug for r in G.outlinks(links, "a").collect()} == {"x", "y"}
    assert {r.target_slug for r in G.outlinks(links, "a", "cites").collect()} == {"y"}
    assert {r.source_slug for r in G.backlinks(links, "x").collect()} == {"a", "b"}
    assert G.direct_links(links, "a", "both").count() == 3
    assert [r.target_slug for r in G.shared_links(links, "a", "b").collect()] == ["x"]
    pairs = spark.createDataFrame([("a", "b"), ("a", "x")], "slug_a string, slug_b string")
    assert [tuple(r) for r in G.shared_links_batch(links, pairs).collect()] == [("a", "b", "x")]
    assert sorted(r.slug for r in G.orphans(pages, links).collect()) == ["b", "q"]
    assert [r.link_type for r in G.link_types(links).collect()] == ["cites", "plain"]
    assert {r.link_type for r in G.link_view(links).collect()} == {"Plain", 'Custom("cites")'}
    assert L.has_link(links, "a", "x").first().has_link and not L.has_link(links, "x", "b").first().has_link
    direct, near = G.graph_query(links, "a")
    assert direct.count() == 2 and near.count() == 2
    slugs = spark.createDataFrame([("a",), ("x",)], "slug string")
    assert G.batch_direct_links(links, slugs, "both").count() == 6


def test_stats(spark):
    pages = pages_df(spark, [{"slug": "a"}, {"slug": "b", "page_type": "Source"}, {"slug": "c"}])
    row = L.collection_stats(pages, links_df(spark, [("a", "b", "plain"), ("a", "zz", "plain")])).first()
    assert (row.total_pages, row.pages_by_type, row.total_links, row.orphan_count) == (3, {"Concept": 2, "Source": 1}, 2, 2)
    empty = L.collection_stats(pages.limit(0), links_df(spark, [("a", "b", "plain")]).limit(0)).first()
    assert (empty.total_pages, empty.pages_by_type, empty.total_links, empty.orphan_count) == (0, {}, 0, 0)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    """A third of the rows on one key, which must be spread and yet join as ever."""
    big = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 700)) AS k", "id")
    small = spark.range(400).selectExpr("IF(id = 0, 'hot', concat('k', id)) AS k", "id AS v")
    assert [r._hot for r in skew.hot_keys(big, "k").collect()] == ["hot"]
    got = sorted(map(tuple, skew.salted_join(big, small, "k", how).collect()), key=str)
    assert got == sorted(map(tuple, big.join(small, "k", how).collect()), key=str)


@pytest.mark.parametrize("broadcast_rows", [0, 1 << 30])
@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_many_starts_at_once(spark, direction, broadcast_rows):
    """As one by one, on a graph with a hub, cycles, self links, unknown and repeated starts; 200 starts are 4 words."""
    r = random.Random(7)
    rows = {(f"p{r.randrange(220)}", f"p{r.randrange(220)}", r.choice(["plain", "cites"])) for _ in range(300)}
    rows |= {(f"p{i}", "hub", "plain") for i in range(150)} | {("p1", "p1", "plain")}
    links = links_df(spark, sorted(rows))
    starts = spark.createDataFrame([(f"p{i}",) for i in range(200)] + [("p3",), ("nowhere",)], "slug string")
    packed, numbers = G.packed_neighbors(links, starts, 3, "plain", direction, broadcast_rows)
    got = sorted(map(tuple, G.unpacked(packed, numbers).collect()))
    assert got == sorted(map(tuple, G.neighbors_of(links, starts, 3, "plain", direction).collect()))
    assert packed.count() * 4 < len(got) or direction != "both"
    counts = {(a, d): n for a, d, n in map(tuple, G.reach_counts(packed, numbers).collect())}
    for a, _, d in got:
        counts[a, d] -= 1
    assert not any(counts.values())
    assert numbers.select("word", "bit").distinct().count() == numbers.count() == 201


@pytest.mark.parametrize("direction", ["in", "both"])
def test_reach_counts_hubs_once(spark, monkeypatch, direction):
    """As page by page, with hubs among the starts, behind one another and on several ways; no frontier has starts times a hub's pages."""
    r = random.Random(9)
    rows = {(f"p{r.randrange(220)}", f"p{r.randrange(220)}", r.choice(["plain", "cites"])) for _ in range(260)}
    rows |= {(f"p{i}", f"hub{i % 2}", "plain") for i in range(150)} | {("hub0", "hub1", "plain"), ("p1", "p1", "plain")}
    links = links_df(spark, sorted(rows))
    starts = spark.createDataFrame([(f"p{i}",) for i in range(0, 220, 2)] + [("hub0",), ("p2",), ("nowhere",)], "slug string")
    want = {}
    for row in G.neighbors_of(links, starts, 3, "plain", direction).collect():
        want[row.start, row.distance] = want.get((row.start, row.distance), 0) + 1
    sizes, whole = [], G.neighbors_of
    monkeypatch.setattr(G, "neighbors_of", lambda *a: sizes.append((df := whole(*a)).count()) or df)
    got = {(a, d): n for a, d, n in G.reach(links, starts, 3, "plain", direction, hub_links=20).collect()}
    assert got == want
    assert sum(sizes) * 2 < sum(want.values()) or direction != "both"


@pytest.mark.parametrize("options", [{}, {"min_shared": 3}, {"min_shared": 1, "min_jaccard": 0.5}, {"block_rows": 3}, {"min_jaccard": 0.4, "block_rows": 5}])
def test_shared_link_pairs_against_all_pairs(spark, options):
    rng = random.Random(8)
    edges = {(f"p{rng.randrange(70)}", f"t{int(rng.random() ** 2 * 25)}") for _ in range(330)}
    edges |= {(f"p{i}", "hub") for i in range(70)} | {(f"copy{i}", t) for i in range(40) for t in ("hub", "t0", "t1")} | {("one", "hub")}
    got = G.shared_link_pairs(links_df(spark, [(a, b, kind) for a, b in edges for kind in ("plain", "cites")]), **options).collect()
    sets = {}
    for a, b in edges:
        sets.setdefault(a, set()).add(b)
    need, jaccard = options.get("min_shared", 2), options.get("min_jaccard", 0.0)
    first = {}
    for a in sorted(sets):
        first.setdefault(frozenset(sets[a]), a)
    want = {(first[frozenset(v)], a, len(v)) for a, v in sets.items() if first[frozenset(v)] != a and len(v) >= need}
    heads = sorted(first.values())
    for i, a in enumerate(heads):
        for b in heads[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n >= need and n / len(sets[a] | sets[b]) >= jaccard:
                want.add((a, b, n))
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert len(want) > 40


@pytest.mark.parametrize("bound", [64, 3, 0])
def test_pairs_that_share_too_little_end_where_they_meet(spark, monkeypatch, bound):
    """Forty pages of one target share a second one in two cases only; sets without hashes give the same result."""
    monkeypatch.setattr(G, "REST_TARGETS", bound)
    edges = [(f"p{i}", t) for i in range(40) for t in ("a", f"b{i}", f"c{i}")] + [("p3", "d"), ("p5", "d"), ("p5", "e"), ("p9", "e")]
    edges += [(f"q{i}", t) for i in range(40) for t in (f"b{i}", f"c{(i + 1) % 40}")]
    sizes, whole = {}, G.written

    def counted(df, name):
        out = whole(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(G, "written", counted)
    got = {tuple(r) for r in G.shared_link_pairs(links_df(spark, [(a, b, "plain") for a, b in edges])).collect()}
    assert got == {("p3", "p5", 2), ("p5", "p9", 2)}
    assert sizes["candidates"] == 2 or bound < 64


def test_shared_link_pairs_of_nothing(spark):
    assert G.shared_link_pairs(links_df(spark, [])).count() == 0
    assert G.shared_link_pairs(links_df(spark, [("a", "x", "plain"), ("b", "x", "plain")])).count() == 0
    with pytest.raises(ValueError):
        G.shared_link_pairs(links_df(spark, []), min_shared=0)


def test_links_of_pairs_are_shuffled_once(spark):
    """One row per page holds its targets; pairs with a page of very many pairs, copies and nulls give the same."""
    links = links_df(spark, [(f"p{i}", f"t{(i + k) % 7}", "plain") for i in range(60) for k in range(3)] * 2 + [("p1", None, "plain"), ("p2", None, "cites")])
    pairs = spark.createDataFrame([("p0", f"p{i}") for i in range(60)] * 2 + [("p1", "p2"), ("p3", "none"), (None, "p1"), ("p5", "p5")], "slug_a string, slug_b string")
    found = G.shared_links_batch(links, pairs)
    own = {f"p{i}": {f"t{(i + k) % 7}" for k in range(3)} for i in range(60)}
    asked = {(r.slug_a, r.slug_b) for r in pairs.collect()}
    want = sorted((a, b, t) for a, b in asked for t in own.get(a, set()) & own.get(b, set()))
    assert sorted(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan and "LeftSemi" not in plan


def test_rows_of_a_target_are_shuffled_once_for_both_sides(spark, monkeypatch):
    """Sides of the pairs are the same rows; neither these nor the edges of the classes are written."""
    links = links_df(spark, [(f"p{i}", f"t{(i * k) % 23}", "plain") for i in range(80) for k in range(1, 5)])
    plans, whole = {}, G.written

    def seen(df, name):
        df.collect()  # the plan is final then
        plans[name] = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        return whole(df, name)

    monkeypatch.setattr(G, "written", seen)
    for threshold in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(threshold, "-1")
    try:
        got = G.shared_link_pairs(links, min_shared=2, block_rows=3).count()
    finally:
        for threshold in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(threshold)
    assert got == G.shared_link_pairs(links, min_shared=2).count() > 50
    assert len([x for x in plans["candidates"].splitlines() if " Exchange hashpartitioning(target" in x and "low" in x and "high" in x]) == 1
    assert not {"prefixes", "class-edges", "classes"} & set(plans)


def test_maybe_in_loses_nothing(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("slug"), "id")
    keys = rows.where("id % 7 = 0").select("slug")
    found = {r.id for r in skew.maybe_in(rows, "slug", keys.unionByName(keys)).collect()}
    assert found >= set(range(0, 5000, 7)) and len(found) < 730
    monkeypatch.setattr(skew, "HASH_BITS", 64)
    assert {r.id for r in skew.maybe_in(rows, "slug", keys).collect()} == set(range(5000))
    assert skew.maybe_in(rows, "slug", keys.limit(0)).count() == 0


def test_reach_stores_a_link_once(spark, monkeypatch):
    """Both directions are read from one table of links, repeated ones included; few hubs need no second table."""
    edges = [(f"p{i}", f"q{i % 40}") for i in range(200)] + [(f"p{i}", "hub") for i in range(0, 200, 3)] + [("hub", "top"), ("p1", "p1"), ("p2", None)]
    links = links_df(spark, [(a, b, kind) for a, b in edges for kind in ("plain", "cites")])
    starts = spark.createDataFrame([(f"p{i}",) for i in range(50)] + [("hub",), ("nowhere",)], "slug string")
    sizes, whole = {}, G.written

    def counted(df, name):
        out = whole(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(G, "written", counted)
    for broadcast_rows in (0, 100_000):
        monkeypatch.setattr(G, "FRONTIER_BROADCAST_ROWS", broadcast_rows)
        got = G.reach(links, starts, depth=3, direction="both", hub_links=10).collect()
        want = G.reach_counts(*G.packed_neighbors(links, starts, 3, direction="both")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 100
    assert sizes["edges"] == 2 * len(edges) and not {"light-steps", "near-pages"} & set(sizes)
