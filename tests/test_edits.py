import hashlib

from helpers import at, indexed, note
from notelattice.operators.edits import apply_edits
from notelattice.schema import EDITS


def edit(slug, seq, body="b", frontmatter=None, content="did", agent="me", etag=None):
    return (slug, seq, body, frontmatter, content, agent, etag, "2025-01-01")


def run(spark, pages, edits):
    out = apply_edits(pages, spark.createDataFrame(edits, EDITS), at(100))
    return {r.slug: r for r in out.upserts.collect()}, {(r.slug, r.seq): (r.status, r.message) for r in out.results.collect()}, out


def test_edit_create_reject(spark):
    pages = indexed(spark, {"wiki/a.md": note("A", "Old [[x]]", extra="date: 2024-01-01\n") + "\n---\n- 2024-01-01: first\n"})
    rows, results, out = run(
        spark,
        pages,
        [
            edit("wiki/a", 1, "One", '{"tags":["t"]}'),
            edit("wiki/a.md", 2, "Two [[y]]", '{"title":"B","date":null}', agent=None),
            edit("wiki/new", 1, "Text", '{"title":"N"}'),
            edit("wiki/none", 1),
            edit("wiki/untitled", 1, frontmatter="{}"),
            edit("wiki/blank", 1, frontmatter='{"title":""}'),
            edit("wiki/type", 1, frontmatter='{"title":"T","page_type":"Foo"}'),
            edit("wiki/quiet", 1, frontmatter='{"title":"T"}', content=""),
            edit("wiki/a", 3, "Three", '{"title":null}'),
            edit("raw/r", 1, "v1", content=None, agent=None),
            edit("raw/r", 2, "v2", content=None, agent=None),
            edit("raw/s", 1, "v", "{}", content=None, agent=None),
            edit("raw/t", 1, "v"),
            edit(".md", 1),
        ],
    )
    a = rows["wiki/a"]
    assert (a.title, a.tags, a.date, a.compiled_truth) == ("B", ["t"], None, "Two [[y]]")
    assert [(e.date, e.content, e.agent) for e in a.timeline] == [
        ("2024-01-01", "first", None), ("2025-01-01", "did", "me"), ("2025-01-01", "did", None),
    ]
    assert a.content_hash == hashlib.sha256(a.raw_content.encode()).hexdigest()
    assert sorted(rows) == ["wiki/a", "wiki/new"] and rows["wiki/new"].page_type == "Entity"
    messages = {s: m for (s, _), (status, m) in results.items() if status == "rejected"}
    assert messages["wiki/none"] == "frontmatter is required when creating a new page"
    assert messages["wiki/untitled"] == "title is required in frontmatter for new pages"
    assert messages["wiki/blank"] == "title must not be empty for new pages"
    assert messages["wiki/type"].startswith("invalid page_type: 'Foo'. Valid types: Entity, Concept")
    assert messages["wiki/quiet"] == "timeline.content is required for wiki pages"
    assert messages["raw/s"] == "frontmatter must not be provided for raw pages"
    assert messages["raw/t"] == "timeline must not be provided for raw pages"
    assert results[("wiki/a", 3)] == ("rejected", "title cannot be null")
    assert messages[None] == "normalizing slug would produce an empty string"
    raw = out.raw_notes.collect()
    assert [(r.path, r.raw_content, r.content_hash) for r in raw] == [("raw/r.md", "v2", hashlib.sha256(b"v2").hexdigest())]
    assert [(r.source_slug, r.target_slug) for r in out.new_links.collect()] == [("wiki/a", "y")]


def test_etag_follows_the_page(spark):
    pages = indexed(spark, {"wiki/a.md": note("A")})
    now = pages.first().content_hash
    one, _, _ = run(spark, pages, [edit("wiki/a", 1, "One")])
    after_one = one["wiki/a"].content_hash
    rows, results, _ = run(
        spark,
        pages,
        [
            edit("wiki/a", 0, "Stale first", etag="0" * 64),
            edit("wiki/a", 1, "One"),
            edit("wiki/a", 2, "Too late", etag=now),
            edit("wiki/a", 3, "Two", etag=after_one),
            edit("wiki/a", 4, "Three", etag=after_one),
            edit("wiki/a", 5, "Four"),
            edit("wiki/b", 1, "New", '{"title":"B"}', etag="not indexed yet, so not compared"),
            edit("wiki/b", 2, "Late", etag="wrong"),
        ],
    )
    status = {k: v[0] for k, v in results.items()}
    assert [status[("wiki/a", n)] for n in range(6)] == ["conflict", "applied", "conflict", "applied", "conflict", "applied"]
    assert results[("wiki/a", 2)][1] == f"etag mismatch: expected {now}, got {after_one}"
    assert rows["wiki/a"].compiled_truth == "Four" and len(rows["wiki/a"].timeline) == 3
    assert status[("wiki/b", 1)] == "applied" and status[("wiki/b", 2)] == "conflict"
    assert rows["wiki/b"].compiled_truth == "New"


def test_batch_equals_one_by_one(spark):
    pages = indexed(spark, {"wiki/a.md": note("A")})
    edits = [edit("wiki/a", n, f"Body {n}\n\n---\n- 2020-01-01: odd", '{"tags":["%d"]}' % n if n % 2 else None) for n in range(4)]
    together, _, _ = run(spark, pages, edits)
    state = pages
    for e in edits:
        state = apply_edits(state, spark.createDataFrame([e], EDITS), at(100)).upserts
    assert state.first().compiled_truth == together["wiki/a"].compiled_truth
    assert state.first().tags == together["wiki/a"].tags == ["3"]


def test_order_errors_and_result_fields(spark):
    pages = indexed(spark, {"wiki/a.md": note("A")})
    rows, results, out = run(
        spark,
        pages,
        [edit("wiki/a", 1, "One [[x]] [[y]]"), edit("wiki/a", 2, "t"), edit("wiki/a.md", 2, "t"), edit("wiki/a", None, "n")],
    )
    assert results[("wiki/a", 2)] == ("rejected", "seq repeats within the page")
    assert results[("wiki/a", None)] == ("rejected", "seq is required")
    one = next(r for r in out.results.collect() if r.status == "applied")
    assert (one.content_hash, one.indexed, one.links_count, one.timeline_count) == (rows["wiki/a"].content_hash, True, 2, 1)
