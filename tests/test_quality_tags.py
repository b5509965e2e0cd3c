import pytest

from helpers import links_df, note, notes_df, pages_df
from notelattice.operators import lookup as L
from notelattice.operators import quality, tags, timeline

ENTRY = [("2024-01-01", None, "e", None)]


def test_lint_and_scopes(spark):
    good = {"title": "T", "compiled_truth": "x", "tags": ["t"], "timeline": ENTRY}
    pages = pages_df(
        spark,
        [
            good | {"slug": "fine"},
            good | {"slug": "bad_slug!", "title": " \t"},
            good | {"slug": "src", "page_type": "Source", "compiled_truth": "\n", "tags": [], "timeline": []},
        ],
    )
    links = links_df(spark, [("fine", "src", "plain"), ("fine", "gone", "plain"), ("fine", "gone", "cites")])
    issues = {tuple(r) for r in quality.lint(pages).collect()}
    assert issues == {
        ("error", "lint", "Page 'bad_slug!' has empty title"),
        ("error", "lint", "Page 'bad_slug!' has invalid slug format"),
        ("warning", "lint", "Page 'src' has empty compiled_truth"),
        ("warning", "lint", "Page 'src' (Source) has empty sources"),
        ("warning", "lint", "Page 'src' has empty tags"),
        ("warning", "lint", "Page 'src' has empty timeline"),
    }
    full = [tuple(r) for r in quality.maintain(pages, links).collect()]
    assert len(full) == 6 + 2 + 2
    assert full.count(("error", "backlinks", "Page 'fine' links to nonexistent page 'gone'")) == 2
    assert quality.maintain(pages, links, "orphans").count() == 2
    assert quality.maintain(pages, links, "backlinks").count() == 2
    with pytest.raises(ValueError):
        quality.maintain(pages, links, "all")


def test_tags(spark):
    pages = pages_df(
        spark,
        [
            {"slug": "rust-web", "title": "B", "tags": ["rust", "web"]},
            {"slug": "rust-systems", "title": "A", "tags": ["rust", "systems", "rust"]},
            {"slug": "none", "title": "C"},
            {"slug": "blank", "title": "D", "tags": ["two words", "Zeta"]},
        ],
    )
    find = lambda wanted, mode="or": [r.slug for r in tags.search_tags(pages, wanted, mode).collect()]
    assert [r.tag for r in tags.list_tags(pages).collect()] == ["Zeta", "rust", "systems", "two words", "web"]
    assert find(["web", "systems"]) == ["rust-systems", "rust-web"]
    assert find(["rust", "web", "rust"], "and") == ["rust-web"]
    assert find(["rust", "web", "nope"], "and") == []
    assert find([]) == [] and find([], "and") == []
    with pytest.raises(ValueError):
        find(["a"], "xor")


def test_listing_and_views(spark):
    notes = notes_df(
        spark,
        {"wiki/a.md": note("A"), "wiki/sub/b.md": note("B"), "wiki/.h/c.md": note(), "wiki/.x.md": note(), "raw/r.md": "any text", "top.md": "no header"},
    )
    listed = lambda d: {(r.path, r.kind) for r in L.list_dir(notes, d).collect()}
    assert listed(".") == {("wiki", "folder"), ("raw", "folder"), ("top.md", "file")}
    assert listed("wiki") == {("wiki/a.md", "file"), ("wiki/sub", "folder")}
    view = {r.slug: r for r in L.page_view(notes).collect()}
    assert view["wiki/a"].frontmatter.title == "A" and view["raw/r"].frontmatter is None
    assert view["raw/r"].body == "any text" and view["raw/r"].timeline == []
    assert "missing opening" in view["top"].error and view["top"].body is None


def test_timeline(spark):
    pages = pages_df(spark, [{"slug": "a", "timeline": [("2024-99-99", None, "x", "me"), ("2024-01-02", None, "y", "me")]}])
    rows = timeline.timeline_entries(pages).collect()
    assert [(r.position, r.day is None) for r in rows] == [(0, True), (1, False)]
    assert {(r.date, r.agent, r.n_entries, r.n_pages) for r in timeline.timeline_stats(pages).collect()} == {
        ("2024-99-99", "me", 1, 1), ("2024-01-02", "me", 1, 1)
    }
