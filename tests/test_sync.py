from pyspark.sql import functions as F

from helpers import at, indexed, links_df, note, notes_df, pages_df
from notelattice.operators import sync as Y
from notelattice.sources.notes import walk


def slugs(df):
    return sorted(r.slug for r in df.collect())


def edges(df):
    return sorted((r.source_slug, r.target_slug, r.link_type) for r in df.collect())


def start(spark):
    pages = indexed(
        spark, {"wiki/same.md": note("Same", "[[wiki/edit]]"), "wiki/edit.md": note("Old", "[[wiki/same]]"), "wiki/gone.md": note("Gone"), "wiki/down.md": note("Down")}
    )
    links = links_df(
        spark,
        [("wiki/same", "wiki/edit", "plain"), ("wiki/same", "wiki/gone", "cites"), ("wiki/edit", "wiki/same", "plain"), ("wiki/gone", "wiki/same", "plain")],
    )
    listed = {
        "wiki/same.md": note("Same", "[[wiki/edit]]"),
        "wiki/edit.md": note("New", "[[wiki/same]] [[x::wiki/new|d]] [[wiki/new]] [[wiki/new|again]] [[wiki/gone]]"),
        "wiki/new.md": note("New page", "no links"),
        "wiki/down.md": None,
        "wiki/broken.md": "no frontmatter",
        "wiki/bad slug.md": note("Bad"),
        "wiki/.hidden.md": note("Hidden"),
        "raw/r.md": "raw",
    }
    return pages, links, notes_df(spark, listed)


def test_mixed_sync(spark):
    out = Y.sync(*start(spark), at(100))
    status = {r.slug: r.status for r in out.status.collect()}
    assert status == {
        "wiki/same": "unchanged", "wiki/edit": "changed", "wiki/new": "new", "wiki/gone": "removed", "wiki/down": "failed",
        "wiki/broken": "new", "wiki/bad slug": "new",
    }
    rows = {r.slug: r for r in out.pages.withColumns({"c": F.unix_seconds("created_at"), "u": F.unix_seconds("updated_at")}).collect()}
    assert sorted(rows) == ["wiki/down", "wiki/edit", "wiki/new", "wiki/same"]
    assert (rows["wiki/edit"].title, rows["wiki/edit"].c, rows["wiki/edit"].u) == ("New", 0, 100)
    assert (rows["wiki/new"].c, rows["wiki/same"].u) == (100, 0)
    assert edges(out.links) == [
        ("wiki/edit", "wiki/new", "plain"), ("wiki/edit", "wiki/new", "x"), ("wiki/edit", "wiki/same", "plain"), ("wiki/same", "wiki/edit", "plain"),
    ]
    assert tuple(out.counts.first()) == (2, 2, 1, 4, 3)
    messages = {r.path: r.message for r in out.errors.collect()}
    assert messages["wiki/down.md"] == "failed to fetch wiki/down.md"
    assert "missing opening" in messages["wiki/broken.md"] and "invalid characters" in messages["wiki/bad slug.md"]


def test_repeated_link_can_be_rejected(spark):
    out = Y.sync(*start(spark), at(100), on_duplicate="reject")
    # wiki/edit holds one link twice: its old links stay, its page is still replaced.
    assert ("wiki/edit", "wiki/same", "plain") in edges(out.links) and ("wiki/edit", "wiki/new", "x") not in edges(out.links)
    assert out.counts.first().n_errors == 4


def test_second_sync_changes_nothing(spark):
    pages, links, notes = start(spark)
    first = Y.sync(pages, links, notes, at(100))
    again = Y.sync(first.pages, first.links, notes, at(200))
    assert tuple(again.counts.first())[:4] == (0, 0, 0, 0)
    assert edges(again.links) == edges(first.links)


def test_removal_scope(spark):
    pages = indexed(spark, {"wiki/a/x.md": note(), "wiki/b/y.md": note()})
    links, nothing = links_df(spark, []), notes_df(spark, {"wiki/a/z.md": note()})
    kept = lambda mode: slugs(Y.sync(pages, links, nothing, at(1), directory="wiki/a", removals=mode).pages)
    assert kept("all") == ["wiki/a/z"]
    assert kept("scoped") == ["wiki/a/z", "wiki/b/y"]
    assert kept("none") == ["wiki/a/x", "wiki/a/z", "wiki/b/y"]


def test_walk_depth_and_hidden(spark):
    deep = {f"wiki/{'d/' * n}n.md": "x" for n in (0, 1, 10, 11)}
    df = notes_df(spark, deep | {"wiki/.git/a.md": "x", "wiki/.a.md": "x", "wiki/t.txt": "x", "other/a.md": "x"})
    assert sorted(r.path for r in walk(df).collect()) == sorted(f"wiki/{'d/' * n}n.md" for n in (0, 1, 10))
    assert "wiki/t.txt" in {r.path for r in walk(df, markdown_only=False).collect()}


def test_reindex_matches_sync_from_nothing(spark):
    pages, links, notes = start(spark)
    fresh, fresh_links, errors = Y.reindex(notes, at(100))
    out = Y.sync(pages.limit(0), links.limit(0), notes, at(100))
    assert slugs(fresh) == slugs(out.pages) and edges(fresh_links) == edges(out.links)
    assert errors.count() == out.errors.count() == 3


def test_upsert_delete_replace(spark):
    pages, links, notes = start(spark)
    later = pages.where("slug = 'wiki/edit'").withColumns({"title": F.lit("X"), "created_at": at(50), "updated_at": at(50)})
    row = Y.upsert_pages(pages, later).where("slug = 'wiki/edit'").select("title", F.unix_seconds("created_at"), F.unix_seconds("updated_at")).first()
    assert tuple(row) == ("X", 0, 50)
    gone = spark.createDataFrame([("wiki/same.md",), ("raw/r",)], "slug string")
    left_notes, left_pages, left_links = Y.delete_pages(notes, pages, links, gone)
    assert "wiki/same" not in slugs(left_pages) and edges(left_links) == []
    assert not {"wiki/same.md", "raw/r.md"} & {r.path for r in left_notes.collect()}
    source = spark.createDataFrame([("wiki/same",)], "slug string")
    assert edges(Y.replace_links(links, source, links_df(spark, [("wiki/same", "n", "plain")])))[-1] == ("wiki/same", "n", "plain")


def test_slug_cleanup(spark):
    pages = pages_df(spark, [{"slug": "a.md"}, {"slug": "b.MD"}, {"slug": "c"}, {"slug": "a", "title": "older"}])
    links = links_df(spark, [("a.md", "b.md", "plain"), ("a", "b", "plain"), ("c", "d", "plain")])
    tidy, tidy_links = Y.clean_slugs(pages, links)
    assert slugs(tidy) == ["a", "b", "c"] and edges(tidy_links) == [("a", "b", "plain"), ("c", "d", "plain")]
    once = Y.clean_slugs(tidy, tidy_links)
    assert slugs(once[0]) == slugs(tidy)


def test_deep_and_duplicate_notes_are_reported_and_kept(spark):
    deep = "wiki/" + "d/" * 11 + "n"
    pages = indexed(spark, {"wiki/a.md": note("A"), f"{deep}.md": note("Deep"), "wiki/gone.md": note("Gone")})
    listed = {f"{deep}.md": note("Deep"), "wiki/a.md": note("A2"), "wiki/a": note("Other"), "wiki/b": note("B")}
    out = Y.sync(pages, links_df(spark, []), notes_df(spark, listed), at(5), markdown_only=False)
    assert {r.slug: r.status for r in out.status.collect()} == {
        "wiki/a": "changed", "wiki/b": "new", deep: "kept", "wiki/gone": "removed",
    }
    assert sorted((r.slug, r.title) for r in out.pages.collect()) == sorted([("wiki/a", "A2"), ("wiki/b", "B"), (deep, "Deep")])
    assert sorted((r.path, r.stage) for r in out.errors.collect()) == sorted([("wiki/a", "duplicate"), (f"{deep}.md", "walk")])
    whole = Y.sync(pages, links_df(spark, []), notes_df(spark, listed), at(5), max_depth=None)
    assert {r.slug: r.status for r in whole.status.collect()}[deep] == "unchanged"


def test_incomplete_folders_lose_nothing(spark):
    pages = indexed(spark, {"wiki/x/a.md": note("A"), "wiki/x/y/b.md": note("B"), "wiki/xy.md": note("C")})
    folders = spark.createDataFrame([("wiki/x",)], "folder string")
    out = Y.sync(pages, links_df(spark, []), notes_df(spark, {"wiki/z.md": note("Z")}), at(5), incomplete=folders)
    status = {r.slug: r.status for r in out.status.collect()}
    assert status == {"wiki/x/a": "kept", "wiki/x/y/b": "kept", "wiki/xy": "removed", "wiki/z": "new"}
    assert [(r.path, r.stage) for r in out.errors.collect()] == [("wiki/x", "list")]


def test_several_arrivals_of_a_path(spark):
    rows = [("wiki/a.md", note("One"), 1), ("wiki/a.md", note("Three"), 3), ("wiki/a.md", note("Two"), 2), ("wiki/a.md", None, 4)]
    rows += [("wiki/b.md", note("Same"), 1), ("wiki/b.md", note("Same"), 1)]
    arrived = spark.createDataFrame(rows, "path string, raw_content string, seq long")
    out = Y.sync(pages_df(spark, []), links_df(spark, []), arrived, at(5))
    assert sorted((r.slug, r.title) for r in out.pages.collect()) == [("wiki/a", "Three"), ("wiki/b", "Same")]
    assert [(r.path, r.stage) for r in out.errors.collect()] == [("wiki/a.md", "fetch")]


def test_no_text_is_shuffled_to_find_what_changed(spark):
    """With notes too large to broadcast, the changed paths are broadcast and the text stays where it is."""
    pages, links, notes = start(spark)
    status = Y.written(Y.classify(pages, notes), "status")
    size = status._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 1 << 20
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parsed = Y.parse_changes(notes, status)
        plan = parsed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert sorted(r.slug for r in parsed.collect()) == ["wiki/bad slug", "wiki/broken", "wiki/edit", "wiki/new"]
        shuffled = Y.parse_changes(notes, status, broadcast_bytes=0)
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, shuffled.collect())) == sorted(map(str, parsed.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
