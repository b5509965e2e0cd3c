import re
from collections import Counter

import corpus_pipeline
import pytest
from cases import no_documents, odd_documents

from notelattice.llm.line_dedup import drop_boilerplate
from notelattice.llm.mixing import mix, repeated, water_fill


def brute_lines(docs, ratio, min_pages):
    keys = lambda text: {x.strip(" \t\r") for x in text.split("\n")} - {""}
    out = []
    for text, host in docs:
        if text is None or host is None:
            out.append(text)
            continue
        own = [t for t, h in docs if h == host]
        kept = []
        for line in text.split("\n"):
            n = sum(line.strip(" \t\r") in keys(t) for t in own if t is not None)
            if line.strip(" \t\r") == "" or n < min_pages or n <= ratio * len(own):
                kept.append(line)
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize(("ratio", "least"), [(0.5, 2), (0.2, 1), (1.0, 1)])
def test_lines_against_brute_force(spark, ratio, least):
    docs = odd_documents(spark)
    got = drop_boilerplate(docs, ratio=ratio, min_pages=least)
    assert got.columns == [c for c in docs.columns if c != "lines_total"] + ["lines_total", "lines_dropped"]
    rows = docs.collect()
    want = brute_lines([(r.text, r.source) for r in rows], ratio, least)
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(
        zip([r.doc_id for r in rows], want, strict=True), key=key
    )


def test_a_hot_site_loses_its_footer_only(spark):
    rows = [(i, f"line {i}\n footer \t", "hot" if i % 3 else f"s{i}") for i in range(90)]
    got = drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.text == (f"line {r.doc_id}" if r.doc_id % 3 else f"line {r.doc_id}\n footer \t") for r in got)


def test_no_documents(spark):
    assert drop_boilerplate(no_documents(spark)).count() == 0
    assert mix(no_documents(spark)).count() == 0
    assert repeated(mix(no_documents(spark))).count() == 0


def test_water_fill(spark):
    sources = spark.createDataFrame([("a", 1000, 5.0), ("b", 10, 2.0), ("c", 1, 1.0)], "s string, size long, weight double")
    got = {r.s: r.target for r in water_fill(sources, 1011.0).collect()}
    assert got["b"] == 30.0 and got["c"] == 3.0 and got["a"] == pytest.approx(978)
    even = {r.s: r.target for r in water_fill(sources, 8.0).collect()}
    assert even == {"a": pytest.approx(5 * 5 / 7), "b": pytest.approx(2 * 5 / 7), "c": 3.0} or even["c"] == 1.0


def test_mix_meets_targets_and_reruns(spark):
    docs = odd_documents(spark)
    for bits in (1, 12):
        mixed = mix(docs, bucket_bits=bits)
        rows = mixed.collect()
        assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(3), bucket_bits=bits).collect()))
        for source in {r.source for r in rows}:
            own = [r for r in rows if r.source == source]
            assert sum(int(r.taken) for r in own) == round(own[0].target)
            assert sum(int(r["size"]) for r in own) == own[0].source_size
            assert all(0 <= int(r.taken) <= 3 * int(r["size"]) for r in own)
    assert sum(r.target for r in {(r.source, r.target): r for r in rows}.values()) == pytest.approx(
        sum(int(r["size"]) for r in rows)
    )


def test_repeated_takes_the_words(spark):
    mixed = mix(odd_documents(spark))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = repeated(mixed).collect()
    assert sum(words(r.text) for r in got) == sum(int(r.taken) for r in mixed.collect())
    assert all(words(r.text) for r in got)


def test_pipeline_mixing_keeps_every_text_whole(spark):
    rows = [(i, f"line {i} one\nline  {i} two, and {'more ' * (i % 7)}", "en", "ab"[i % 2], 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts, got = {r[0]: r[1] for r in rows}, corpus_pipeline.mixing(spark, docs, "").collect()
    assert all(r.text == texts[r.doc_id] for r in got)
    words, most = Counter(), max(len(t.split()) for t in texts.values())
    for r in got:
        words[r.source] += len(r.text.split())
    for r in mix(docs, weights=[5, 2, 1]).select("source", "target").distinct().collect():
        assert abs(words[r.source] - r.target) <= most / 2 + 1
