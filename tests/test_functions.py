import random

from pyspark.sql import functions as F

from helpers import note, parsed
from notelattice.functions import frontmatter as FM
from notelattice.functions import text as X
from notelattice.functions.wikilinks import extract_links
from notelattice.operators.parse import page_links, parse_notes, render_notes
from notelattice.schema import FRONTMATTER_KEYS


def test_slug_rules(spark):
    cases = {
        "": "must not be empty",
        "a" * 255: None,
        "a" * 256: "got 256 characters",
        "é" * 128: "got 256 characters",
        "a..b": "path traversal",
        "/a": "start or end",
        "a/": "start or end",
        "a b": "invalid characters",
        "a\n": "invalid characters",
        "wiki/A_1-x.y": None,
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    for row in df.select("s", X.slug_error(F.col("s")).alias("e")).collect():
        wanted = cases[row.s]
        assert (row.e is None) if wanted is None else (wanted in row.e), row


def test_slug_conversions(spark):
    df = spark.createDataFrame([("a.md",), ("a",), ("a.md.md",), (".md",), ("raw/x",), ("rawx",), ("a/.b",)], "s string")
    c = F.col("s")
    out = {
        r.s: (r.n, r.p, r.h, r.r)
        for r in df.select(
            "s", X.normalize_slug(c).alias("n"), X.slug_to_path(c).alias("p"), X.is_hidden(c).alias("h"), X.is_raw_path(c).alias("r")
        ).collect()
    }
    assert out["a.md"] == ("a", "a.md", False, False)
    assert out["a"] == ("a", "a.md", False, False)
    assert out["a.md.md"][0] == "a.md"
    assert out[".md"][0] is None
    assert out["raw/x"][3] and not out["rawx"][3]
    assert out["a/.b"][2]


def test_full_note(spark):
    raw = (
        "---\ntitle: A title\npage_type: Source\ntags: [x, 'y z']\nsources:\n- https://s\ndate: 2024-01-01\nother: {a: 1}\n---\n"
        "Truth with [[a]] and [[t::b|B]].\n\n---\n\n- 2024-01-02 [https://u]: with url\n- 2024-01-03: plain\n"
    )
    row = parsed(spark, {"p": raw})["p"]
    assert row.parse_error is None
    assert (row.title, row.page_type, row.tags, row.sources) == ("A title", "Source", ["x", "y z"], ["https://s"])
    assert (row.date, row.visibility, row.created_by) == ("2024-01-01", "shared", None)
    assert row.compiled_truth == "Truth with [[a]] and [[t::b|B]]."
    assert [tuple(e) for e in row.timeline] == [
        ("2024-01-02", "https://u", "with url", None),
        ("2024-01-03", None, "plain", None),
    ]
    assert row.timeline_text == "with url plain"


def test_body_split(spark):
    bodies = {
        "last": ("Above.\n\n---\n\nBelow.\n\n---\n\n- 2024-01-01: e\n", "Above.\n\n---\n\nBelow.", 1),
        "backtick": ("A.\n\n```md\n---\n```\n\nB.\n\n---\n- 2024-06-15: e\n", "A.\n\n```md\n---\n```\n\nB.", 1),
        "tilde": ("A.\n~~~\n---\n~~~\nB.\n  ---  \n- 2024-06-15: e\n", "A.\n~~~\n---\n~~~\nB.", 1),
        "unclosed": ("A.\n\n```\n---\n- 2024-01-01: no\n", "A.\n\n```\n---\n- 2024-01-01: no", 0),
        "longer closes": ("```\n---\n`````\nB\n---\n- 2024-01-01: e\n", "```\n---\n`````\nB", 1),
        "shorter does not": ("`````\n```\n---\n- 2024-01-01: e\n", "`````\n```\n---\n- 2024-01-01: e", 0),
        "no fence line": ("```a`b\n---\n- 2024-01-01: e\n", "```a`b", 1),
        "none": ("Just text.\n", "Just text.", 0),
        "empty truth": ("---\n- 2024-01-01: e\n", "", 1),
        "crlf": ("A\r\nB\r\n---\r\n- 2024-01-01: e\r\n", "A\nB", 1),
    }
    rows = parsed(spark, {k.replace(" ", "_"): note() [:-6] + v[0] for k, v in bodies.items()})
    for name, (_, truth, n) in bodies.items():
        row = rows[name.replace(" ", "_")]
        assert (row.compiled_truth, len(row.timeline)) == (truth, n), name


def test_timeline_lines(spark):
    lines = [
        "- 2026-05-09 [bot]: update",
        "- 2024-99-99: shape only",
        "-2024-01-01: no blank",
        "- 2024-1-01: short",
        "- 2024-01-01 no colon",
        "- 2024-01-01 [x] text",
        "- 2024-01-01 []: empty agent",
        "  - 2024-01-01 :  spaced  ",
        "* 2024-01-01: star",
        "- 2024-01-é1: bytes",
    ]
    row = parsed(spark, {"p": note(body="---\n" + "\n".join(lines))})["p"]
    assert [(e.date, e.agent, e.content) for e in row.timeline] == [
        ("2026-05-09", "bot", "update"),
        ("2024-99-99", None, "shape only"),
        ("2024-01-01", "", "empty agent"),
        ("2024-01-01", None, "spaced"),
    ]


def test_frontmatter_cases(spark):
    block = lambda yaml: f"---\n{yaml}\n---\nB"
    raws = {
        "empty": "---\n---\nB",
        "blank": block("  "),
        "unknown": block("title: T\nfoo: bar\nnested:\n  a: 1"),
        "quotes": block("title: \"a \\\"b\\\" \\\\ c\"\ncreated_by: 'it''s'"),
        "comment": block("title: T # note\ntags: # none\n- a # one\n- 'b # c'"),
        "nulls": block("title: T\ndate: null\ncreated_by: ~"),
        "flow": block("tags: [ a , \"b, c\", 'd' ]\nsources: []"),
        "open": "title: x\n---\n",
        "close": "---\ntitle: x\n",
        "type": block("title: T\npage_type: Foo"),
        "list": block("title: T\ntags: a"),
        "mapping": block("title: a: b"),
        "twice": block("title: a\ntitle: b"),
        "folded": block("title: a\n  more"),
    }
    rows = parsed(spark, raws)
    assert rows["empty"].title == "" and rows["empty"].page_type == "Entity" and rows["empty"].compiled_truth == "B"
    assert rows["blank"].parse_error is None and rows["unknown"].parse_error is None
    assert (rows["quotes"].title, rows["quotes"].created_by) == ('a "b" \\ c', "it's")
    assert (rows["comment"].title, rows["comment"].tags) == ("T", ["a", "b # c"])
    assert rows["nulls"].date is None and rows["nulls"].created_by is None
    assert (rows["flow"].tags, rows["flow"].sources) == (["a", "b, c", "d"], [])
    assert "missing opening" in rows["open"].parse_error
    assert "missing closing" in rows["close"].parse_error
    for bad in ("type", "list", "mapping", "twice", "folded"):
        assert rows[bad].parse_error, bad


def test_render_then_parse(spark):
    titles = ["plain", " lead", "a: b", "a #b", "it's", "'q'", "true", "12", "-", "- x", "", "[x]", "two\nlines", "é 测试", "#x", "null", "x:"]
    df = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(titles)], "slug string, title string").selectExpr(
        "slug", "title", "'Query' AS page_type", "array(title, 'x') AS tags", "array() AS sources", "CAST(NULL AS string) AS date",
        "'shared' AS visibility", "'me' AS created_by", "'Some truth.' AS compiled_truth",
        "array(named_struct('date','2024-01-01','source_url',CAST(NULL AS string),'content','c','agent','a')) AS timeline",
    ).withColumn("sources", F.array().cast("array<string>"))
    once = render_notes(df)
    again = parse_notes(once.select("slug", "raw_content"))
    back = {r.slug: r for r in again.collect()}
    for i, title in enumerate(titles):
        row = back[f"p{i}"]
        assert row.parse_error is None, (title, row.raw_content)
        assert (row.title, row.tags) == (title, [title, "x"]), row.raw_content
        assert row.timeline[0].agent == "a"
    assert back["p0"].raw_content == (
        "---\ntitle: plain\npage_type: Query\ntags:\n- plain\n- x\nsources: []\ndate: null\nvisibility: shared\ncreated_by: me\n---\n"
        "Some truth.\n\n---\n- 2024-01-01 [a]: c\n"
    )
    twice = {r.slug: r.raw_content for r in render_notes(again.drop("raw_content")).collect()}
    assert all(twice[s] == r.raw_content for s, r in back.items())


def test_merge(spark):
    updates = {
        "{}": None,
        '{"title":"N","tags":["a"],"zzz":1}': None,
        '{"date":null,"created_by":null}': None,
        "[1]": None,
        '{"title":null}': "title cannot be null",
        '{"page_type":"Foo"}': "page_type",
        '{"tags":null}': "tags",
        '{"tags":[1]}': "tags",
        '{"sources":"x"}': "sources",
        '{"visibility":null}': "visibility",
        '{"date":5}': "date",
        '{"title":7}': "title",
    }
    df = spark.createDataFrame([(u,) for u in updates], "u string").selectExpr(
        "u", "'old' AS title", "'Concept' AS page_type", "array('t') AS tags", "array('s') AS sources", "'2024-01-01' AS date",
        "'shared' AS visibility", "'me' AS created_by",
    )
    merged = FM.merge_frontmatter({k: F.col(k) for k in FRONTMATTER_KEYS}, F.col("u"))
    rows = {r.u: r for r in df.select("u", FM.updates_error(F.col("u")).alias("e"), F.struct(*[v.alias(k) for k, v in merged.items()]).alias("m")).collect()}
    for u, wanted in updates.items():
        assert (rows[u].e is None) if wanted is None else (wanted in rows[u].e), (u, rows[u].e)
    assert rows["{}"].m.title == "old"
    changed = rows['{"title":"N","tags":["a"],"zzz":1}'].m
    assert (changed.title, changed.tags, changed.sources) == ("N", ["a"], ["s"])
    cleared = rows['{"date":null,"created_by":null}'].m
    assert cleared.date is None and cleared.created_by is None
    assert rows["[1]"].m.title == "old"


def test_wikilinks(spark):
    cases = {
        "[[a]] x [[b]]": [("a", "plain", None), ("b", "plain", None)],
        "[[t::b|B c]]": [("b", "t", "B c")],
        "[[ my type :: my target ]]": [("my target", "my type", None)],
        "Use `[[no]]` and [[yes]].": [("yes", "plain", None)],
        "[[]] [[ ]] [[|x]] [[::a]] [[a::]] [[.md]]": [],
        "Broken [[x and more": [],
        "[[[target]]]": [("[target", "plain", None)],
        "[[a]][[b]]": [("a", "plain", None), ("b", "plain", None)],
        "[[a|]]": [("a", "plain", None)],
        "[[x.md|D]] [[cites::p.md]]": [("x", "plain", "D"), ("p", "cites", None)],
        "[[1]]\n```\n[[2]]\n```\n[[3]]\n```\n[[4]]": [("1", "plain", None), ("3", "plain", None)],
        " ```\n[[kept]]": [],
        "odd ` tick [[hidden]]\n[[hidden too]]": [],
        "[[outer [[inner]]": [("inner", "plain", None)],
        "[[two\nlines]]": [("two\nlines", "plain", None)],
        "[[a::b::c]]": [("b::c", "a", None)],
        "`a`[[l]]": [("l", "plain", None)],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", extract_links(F.col("t")).alias("l"))
    for row in df.collect():
        assert [tuple(x) for x in row.l] == cases[row.t], row.t


def test_long_text_links(spark):
    df = spark.createDataFrame([("p", "word [x] " * 60_000 + "[[end]]")], "slug string, compiled_truth string")
    assert [r.target_slug for r in page_links(df).collect()] == ["end"]


def test_self_links_are_dropped(spark):
    df = spark.createDataFrame([("me", "[[me]] [[me|x]] [[other]]")], "slug string, compiled_truth string")
    assert [(r.source_slug, r.target_slug) for r in page_links(df).collect()] == [("me", "other")]


def test_double_quoted_escapes(spark):
    texts = {
        r'"C:\\new"': "C:\\new",
        r'"caf\u00e9"': "café",
        r'"\x41\U0001F600\/\e"': "A\U0001F600/\x1b",
        r'"\\n\n"': "\\n\n",
        r'"\q"': None,
        r'"\ud800"': None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.v for r in df.select("t", FM._decode_scalar(F.col("t")).alias("v")).collect()}
    assert got == texts


def test_scalars_survive_rendering(spark):
    draw = random.Random(11)
    alphabet = "ab \\\"'#:-\t\n\r\x00\x07\x1b\x7f\x85\xa0é日\u2028\ufeff\U0001F600[]{},&*!|>%@`~?0"
    values = ["".join(draw.choices(alphabet, k=draw.randint(0, 8))) for _ in range(600)]
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("r", FM.render_scalar(F.col("v")))
    rows = df.select("v", "r", FM._decode_scalar(F.col("r")).alias("back")).collect()
    assert [(r.v, r.r) for r in rows if r.back != r.v] == []


def test_each_key_is_searched_for_once(spark):
    """Values are decoded from texts that an earlier step found, so no expression of a later one searches again."""
    from notelattice.functions import frontmatter as FM

    later = [*FM.read_values().values(), *FM.decode_values().values()]
    assert not any("(?md)^" in str(c) for c in later)
    raw = {k: str(c) for k, c in FM.raw_values(F.col("y")).items()}
    assert all(text.count("(.*))?$") <= 2 for text in raw.values())


def test_links_are_found_as_by_the_plain_pattern(spark):
    """Runs of other characters are passed over whole; what is found is what a search at every character finds."""
    import random

    from notelattice.functions.wikilinks import WIKILINK, link_bodies

    plain = WIKILINK.replace("[^`\\[]*+(?:", "", 1).removesuffix("|.|\\z)")
    assert plain != WIKILINK and len(plain) < len(WIKILINK) - 10
    r = random.Random(5)
    parts = ["[", "[[", "]]", "]", "`", "```", "\n", "\n```", "a", "b::c", "|", "~~~", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.filter(F.regexp_extract_all("t", F.lit(plain), F.lit(1)), lambda x: x != "")
    assert df.where(F.coalesce(link_bodies(F.col("t")) != F.when(F.col("t").contains("[["), old).otherwise(F.array().cast("array<string>")), F.lit(True))).collect() == []
    long = spark.range(1).select(F.concat(F.lit("[[a]] "), F.repeat(F.lit("x"), 3_000_000)).alias("t"))
    assert long.select(link_bodies(F.col("t")).alias("l")).first().l == ["a"]


def test_links_and_texts_are_trimmed_once(spark):
    """A link's parts are named step by step, the end of a long text is looked at before it is trimmed; same results."""
    from notelattice.functions.text import trim_long, trim_ws
    from notelattice.functions.wikilinks import parse_links
    from notelattice.operators import parse
    from notelattice.schema import WHITESPACE

    assert str(parse_links(F.col("found"))).count("trim(") <= 8
    assert not any("compiled_truth" in c for c in parse._body_columns())
    r = random.Random(7)
    parts = [*WHITESPACE, "a", "é", "測", "😀", "​", "\x00", "﻿"]
    texts = ["".join(r.choices(parts, k=r.randrange(6))) for _ in range(2000)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(~trim_long(F.col("t")).eqNullSafe(trim_ws(F.col("t")))).collect() == []
    inner = [" a | b ", "k :: t.md", "|x", "::", "a::", " ::b", "a|", "a::b::c|d|e", "", " a.md "]
    got = spark.createDataFrame([(inner,)], "found array<string>").select(parse_links(F.col("found")).alias("l")).first().l
    assert [tuple(x) for x in got] == [
        ("a", "plain", "b"), ("t", "k", None), (None, "plain", "x"), (None, "", None), (None, "a", None), (None, "", None),
        ("a", "plain", None), ("b::c", "a", "d|e"), (None, "plain", None), ("a", "plain", None),
    ]


def test_body_is_cut_at_marks_alone(spark):
    """Only lines that may be fences or separators are strings of their own; truth and timeline are as by lines."""
    from notelattice.functions import body as B

    r = random.Random(3)
    parts = ["\n", "\r\n", "---", "--- ", "  ---", "```", "~~~", "````", "a", "- 2024-01-02: x", " ", "\n---\n", "\r", "--"]
    texts = ["".join(r.choices(parts, k=r.randrange(14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "b string").withColumn("c", B.body_chunks(F.col("b")))
    df = df.withColumn("last", B.last_separator(F.col("c")))
    truth, section = B.split_body(F.col("b"), F.col("c"), F.col("last"))
    lines = F.split(F.replace("b", F.lit("\r\n"), F.lit("\n")), "\n")
    by_line = df.withColumns({"truth": truth, "section": section, "lines": lines}).withColumn("n", B.last_separator(F.col("lines")))
    want_truth = F.when(F.col("n") < 0, F.col("b")).otherwise(F.array_join(F.slice("lines", F.lit(1), F.col("n")), "\n"))
    want = F.when(F.col("n") < 0, F.array().cast("array<string>")).otherwise(F.slice("lines", F.col("n") + 2, F.size("lines")))
    assert by_line.where(~(F.col("truth").eqNullSafe(want_truth) & F.col("section").eqNullSafe(want))).collect() == []
    long = spark.createDataFrame([("one\ntwo\n" * 50 + "---\n",)], "b string").select(F.size(B.body_chunks(F.col("b"))).alias("n"))
    assert long.first().n == 2
