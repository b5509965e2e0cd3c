import json

from pyspark.sql import functions as F

from helpers import at, indexed, note, notes_df
from notelattice.schema import EDITS
from notelattice.operators import file_sync, sync
from notelattice.session import qualified, scratch_path, shared_folder, written
from notelattice.sources import envelopes, files, notes, tables
from notelattice.streaming import edits as stream_edits
from notelattice.streaming import sync as stream_sync
from notelattice.streaming import log
from notelattice.sources.tables import write_version
from notelattice.operators import sync
from notelattice.streaming.log import current_links, current_pages


def test_read_note_files(spark, tmp_path):
    for path, text in {"wiki/a.md": "A\nb", "wiki/sub dir/b+c.md": "B", "raw/c.md": "C", "wiki/d.txt": "D", "wiki/.h.md": "H"}.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    got = {r.path: r.raw_content for r in notes.read_notes(spark, str(tmp_path)).collect()}
    assert got == {"wiki/a.md": "A\nb", "wiki/sub dir/b+c.md": "B", "raw/c.md": "C"}
    everything = notes.read_notes(spark, str(tmp_path), markdown_only=False)
    assert everything.count() == 4
    assert notes.get_note(everything, "wiki/a.md").first().raw_content == "A\nb"
    assert [r.path for r in notes.list_folders(everything, "wiki").collect()] == ["wiki/sub dir"]


def test_names_that_the_lister_skips(spark, tmp_path):
    names = ["_x.md", "_a=b.md", "_metadata.md", "_metadata/x.md", "_f/y.md", "_k=v/z.md", "d/_f/__g/w.md", "d/a_b.md", "_f/.h/x.md", "_f/t.txt", "+ _%/_ü #.md"]
    for name in names:
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(name)
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "_f/bad.md").write_bytes(b"\xff!")
    got = notes.read_notes(spark, str(tmp_path)).collect()
    want = {n: n for n in names if n.endswith(".md") and "/." not in n} | {"empty.md": "", "_f/bad.md": "\ufffd!"}
    assert len(got) == len(want) and {r.path: r.raw_content for r in got} == want
    assert {r.path for r in files.list_files(spark, str(tmp_path)).collect()} == want.keys()


def test_files_are_written_changed_and_removed(spark, tmp_path):
    root = str(tmp_path)
    listed = lambda: written(files.list_files(spark, root), "listing")
    none = listed()
    files.write_files(notes_df(spark, {"wiki/a.md": note("A"), "wiki/_b.md": note("B"), "wiki/c.md": note("C"), "wiki/d.md": None}), root)
    pages, links, _ = sync.reindex(notes_df(spark, {}), at(1))
    _, pages, links, before = file_sync.sync_files(pages, links, root, none, at(1))
    assert {r.slug for r in pages.collect()} == {"wiki/a", "wiki/_b", "wiki/c"}
    files.write_files(notes_df(spark, {"wiki/a.md": note("A new title"), "wiki/e/_c.md": note("C"), "wiki/bad.md": "x"}), root)
    files.delete_files(notes_df(spark, {"wiki/c.md": None, "wiki/unknown.md": None}), root)
    now = listed()
    assert {tuple(r) for r in files.changes(before, now).collect()} == {
        ("wiki/a.md", "changed"), ("wiki/e/_c.md", "new"), ("wiki/bad.md", "new"), ("wiki/c.md", "removed"),
    }
    outcome, pages, links, after = file_sync.sync_files(written(pages, "p"), written(links, "l"), root, before, at(2))
    assert {r.slug: r.title for r in pages.collect()} == {"wiki/a": "A new title", "wiki/_b": "B", "wiki/e/_c": "C"}
    assert [(r.path, r.stage) for r in outcome.errors.collect()] == [("wiki/bad.md", "parse")]
    assert files.changes(after, listed()).count() == 0
    gone = files.read_files(spark, root, spark.createDataFrame([("wiki/c.md", 0, 1)], files.LISTING))
    assert [tuple(r) for r in gone.collect()] == [("wiki/c.md", None)]


def test_put_append_delete(spark):
    df = notes_df(spark, {"a.md": "1", "b.md": "2"})
    put = notes.put_notes(df, notes_df(spark, {"b.md": "3", "c.md": "4"}))
    lost = notes.missing_appends(put, spark.createDataFrame([("a.md",), ("zz.md",)], "path string"))
    assert [(r.path, r.stage) for r in lost.collect()] == [("zz.md", "append")]
    added = notes.append_notes(put, spark.createDataFrame([("a.md", "+"), ("zz.md", "+")], "path string, content string"))
    left = notes.delete_notes(added, spark.createDataFrame([("c.md",)], "path string"))
    assert {r.path: r.raw_content for r in left.collect()} == {"a.md": "1+", "b.md": "3"}


def test_envelopes(spark, tmp_path):
    lines = [
        {"code": 1, "status": True, "message": "Success", "data": {"list": [{"path": "a.md", "content": "A"}, {"path": "b.md"}], "pager": {"totalRows": 2}}},
        {"code": 1, "data": {"list": None, "pager": {"totalRows": 0}}},
        {"code": 430, "message": None},
        {"code": 305, "message": "denied"},
    ]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    good, errors = envelopes.decode_envelopes(envelopes.read_envelopes(spark, str(tmp_path)))
    assert sorted(map(tuple, good.collect())) == [("a.md", "A"), ("b.md", None)]
    assert sorted(map(tuple, errors.collect())) == [
        ("decode", "invalid response"), ("not_found", "Note does not exist"), ("service", "denied"),
    ]


def test_versions(spark):
    root = scratch_path(spark, "versions")
    for version, n in ((0, 1), (1, 2), (1, 3)):
        tables.write_version(spark.range(n), root, version)
    assert tables.finished_versions(spark, root) == [0, 1]
    assert tables.read_version(spark, root).count() == 3
    assert tables.read_version(spark, root, 0).count() == 1
    assert {r.version for r in tables.read_log(spark, root).collect()} == {0, 1}
    assert root.startswith(shared_folder(spark))


def test_stream_sync(spark):
    first = notes_df(spark, {"wiki/a.md": note("A", "[[wiki/b]] [[wiki/c]]"), "wiki/b.md": note("B"), "wiki/x.md": "broken"})
    second = notes_df(spark, {"wiki/a.md": note("A2", "[[wiki/c]]"), "wiki/b.md": note("B"), "wiki/c.md": note("C")})
    pages, links, errors = stream_sync.replay(spark, [first, second], at(7))
    assert {r.slug: r.title for r in pages.collect()} == {"wiki/a": "A2", "wiki/b": "B", "wiki/c": "C"}
    assert [(r.source_slug, r.target_slug) for r in links.collect()] == [("wiki/a", "wiki/c")]
    assert [(r.path, r.stage) for r in errors.collect()] == [("wiki/x.md", "parse")]
    together = stream_sync.replay(spark, [first, second], at(7), together=True)
    assert sorted((r.slug, r.title) for r in together[0].collect()) == [("wiki/a", "A2"), ("wiki/b", "B"), ("wiki/c", "C")]


def test_stream_from_files(spark, tmp_path):
    (tmp_path / "in" / "wiki").mkdir(parents=True)
    (tmp_path / "in" / "wiki" / "a.md").write_text(note("A", "[[b]]"))
    root = scratch_path(spark, "files")
    for name in ("a", "b"):
        (tmp_path / "in" / "wiki" / f"{name}.md").write_text(note(name, "[[b]]"))
        stream = notes.stream_notes(spark, str(tmp_path / "in"))
        stream_sync.start_sync(stream, root, f"{root}/progress", at(1)).awaitTermination()
    assert sorted(r.slug for r in current_pages(spark, root).collect()) == ["wiki/a", "wiki/b"]
    assert current_links(spark, root).count() == 2


def test_stream_edits(spark):
    pages = indexed(spark, {"wiki/a.md": note("A"), "wiki/b.md": note("B")})
    row = lambda slug, seq, etag=None: (slug, seq, f"Body {seq}", '{"title":"N"}', f"t{seq}", None, etag, "2025-01-01")
    parts = [
        spark.createDataFrame([row("wiki/a", 1), row("wiki/n", 1)], EDITS),
        spark.createDataFrame([row("wiki/a", 2), row("wiki/a", 3, "stale"), row("wiki/n", 2)], EDITS),
    ]
    state = {r.slug: r for r in stream_edits.replay(spark, pages, parts, at(9)).collect()}
    assert sorted(state) == ["wiki/a", "wiki/n"]
    assert state["wiki/a"].compiled_truth == "Body 2" and state["wiki/n"].timeline_text == "t1 t2"


def state(spark, root):
    pages = sorted((r.slug, r.content_hash, r.title) for r in current_pages(spark, root).collect())
    return pages, sorted(tuple(r) for r in current_links(spark, root).collect())


def test_compaction(spark):
    """A snapshot changes no answer, readers opened before still work, and the stream goes on behind it."""
    root = scratch_path(spark, "log")
    batches = [
        {"wiki/a.md": note("A", "see [[wiki/b]]"), "wiki/b.md": note("B", "see [[wiki/a]] and [[wiki/c]]")},
        {"wiki/a.md": note("A2", "see [[wiki/c]]"), "wiki/c.md": note("C")},
        {"wiki/b.md": note("B3", "nothing")},
    ]
    for k, batch in enumerate(batches):
        notes_df(spark, batch).withColumn("seq", F.lit(k).cast("long")).write.mode("append").parquet(f"{root}/arrivals")
        stream = spark.readStream.schema(stream_sync.ARRIVALS).parquet(f"{root}/arrivals")
        stream_sync.start_sync(stream, root, f"{root}/progress", at(k)).awaitTermination()
        if k == 0:
            assert log.compact(spark, root) is None  # the newest version may be written again
    before = state(spark, root)
    assert [p[2] for p in before[0]] == ["A2", "B3", "C"] and [x[:2] for x in before[1]] == [("wiki/a", "wiki/c")]
    opened = current_pages(spark, root)
    assert log.compact(spark, root) == 1 and log.compact(spark, root) == 1
    assert state(spark, root) == before
    assert sorted(r.title for r in opened.collect()) == ["A2", "B3", "C"]
    files = {f.rsplit("/", 2)[-2] for f in current_pages(spark, root).inputFiles()}
    assert files == {"version=1", "version=2"} and any("snapshots" in f for f in current_pages(spark, root).inputFiles())
    # The batch of the newest version runs once more: it must not see itself.
    assert sorted(r.slug for r in log.current_hashes(spark, root, below=2).collect()) == ["wiki/a", "wiki/b", "wiki/c"]
    assert log.snapshot_version(spark, root, below=1) is None
    assert log.vacuum(spark, root) == [0, 1] and log.vacuum(spark, root) == []
    assert state(spark, root) == before
    notes_df(spark, {"wiki/c.md": note("C4", "[[wiki/a]]")}).withColumn("seq", F.lit(9).cast("long")).write.mode("append").parquet(f"{root}/arrivals")
    stream = spark.readStream.schema(stream_sync.ARRIVALS).parquet(f"{root}/arrivals")
    stream_sync.start_sync(stream, root, f"{root}/progress", at(9)).awaitTermination()
    assert log.compact(spark, root) == 2
    assert [p[2] for p in state(spark, root)[0]] == ["A2", "B3", "C4"]
    assert [x[:2] for x in state(spark, root)[1]] == [("wiki/a", "wiki/c"), ("wiki/c", "wiki/a")]


def test_writes_of_one_note(spark):
    df = notes_df(spark, {"a.md": "x", "b.md": None})
    both = spark.createDataFrame([("a.md", 2, "2"), ("a.md", 1, "1"), ("a.md", 3, None), ("b.md", 1, "1"), ("c.md", 1, "1")], "path string, seq int, content string")
    added = notes.append_notes(df, both)
    assert sorted(map(tuple, added.collect())) == [("a.md", "x12"), ("b.md", None)]
    said = sorted((r.path, r.message) for r in notes.write_errors(df, appends=both).collect())
    assert [m[0] for m in said] == ["a.md", "b.md", "c.md"] and "not exist" in said[2][1]
    puts = both.withColumnRenamed("content", "raw_content")
    assert sorted(map(tuple, notes.put_notes(df, puts).collect())) == [("a.md", "2"), ("b.md", "1"), ("c.md", "1")]
    assert [r.message for r in notes.write_errors(df, puts=puts).collect()] == ["no content to write: a.md"]
    plain = both.drop("seq").where("content is not null")
    assert sorted(map(tuple, notes.append_notes(df, plain).collect()))[0] == ("a.md", "x12")


def test_folders_without_scheme_stand_in_the_default_file_system(spark):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert qualified(spark, "/shared/x") == "file:/shared/x"
    try:
        conf.set("fs.defaultFS", "viewfs://cluster/")
        conf.set("fs.viewfs.mounttable.cluster.link./shared", "file:///tmp")
        assert qualified(spark, "/shared/x") == "viewfs://cluster/shared/x"
        assert qualified(spark, "file:///shared/x") == "file:/shared/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_text_of_what_stays_is_not_moved(spark, monkeypatch):
    """A compaction takes superseded rows out by a broadcast; arrivals of one path are combined where they were joined."""
    root = scratch_path(spark, "log")
    for v, slugs in enumerate((["a", "b"], ["b", "c"], ["d"])):
        write_version(indexed(spark, {f"wiki/{s}.md": note(f"{s}{v}") for s in slugs}), f"{root}/pages", v)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(log._kept_pages(spark, root, 1))
    kept = log._kept_pages(spark, root, 2)
    assert "BroadcastHashJoin" in plan(kept) and "Exchange hashpartitioning" not in plan(kept)
    assert sorted(r.title for r in kept.collect()) == ["a0", "b1", "c1"]

    notes = notes_df(spark, {"wiki/a.md": note("A")}).withColumn("seq", F.lit(0))
    status = sync.classify(indexed(spark, {}), notes.unionByName(notes))
    parsed = sync.parse_changes(notes.unionByName(notes), status, broadcast_bytes=0)
    assert plan(parsed).count("Exchange hashpartitioning(slug") == 0 and [r.title for r in parsed.collect()] == ["A"]


def test_whole_texts_are_stored_small(spark):
    root = scratch_path(spark, "log")
    notes_df(spark, {"wiki/a.md": note("A")}).withColumn("seq", F.lit(0).cast("long")).write.parquet(f"{root}/arrivals")
    stream = spark.readStream.schema(stream_sync.ARRIVALS).parquet(f"{root}/arrivals")
    stream_sync.start_sync(stream, root, f"{root}/progress", at(0)).awaitTermination()
    assert all(".zstd." in f for f in current_pages(spark, root).inputFiles())


def test_files_are_read_by_many_tasks(spark, tmp_path):
    """Few bytes of paths are still many files: they are not put together into one task; batches hold all of them."""
    from notelattice.sources import files as FI

    rows = [(f"wiki/{i % 3}/n{i}.md", f"text {i}") for i in range(200)] + [("wiki/empty.md", "")]
    FI.write_files(spark.createDataFrame(rows, "path string, raw_content string").repartition(2), str(tmp_path))
    listing = FI.list_files(spark, str(tmp_path))
    found = FI.read_files(spark, str(tmp_path), listing.unionByName(spark.createDataFrame([("gone.md", 0, 0)], FI.LISTING)))
    assert sorted(tuple(r) for r in found.collect()) == sorted([*rows, ("gone.md", None)], key=lambda r: r[0])
    assert found.select(F.spark_partition_id().alias("task")).distinct().count() > 1
