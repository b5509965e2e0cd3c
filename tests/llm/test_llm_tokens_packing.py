import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import TEXTS, no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from notelattice.llm import packing
from notelattice.llm.token_counts import PieceCounter, token_counts

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = st.text(alphabet=st.sampled_from("ab É▁ \n\t ­\x1c'sİΣ日½<|>.é́"), max_size=40)


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(PIECES, memory=50)


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(WORDS, memory=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_piece_counts_equal_the_library(counter, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert counter.count(texts) == [len(x) for x in model.encode(texts, num_threads=1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_word_ids_equal_the_library(encoder, texts):
    library = Tokenizer.from_file(WORDS)
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want


def test_all_latin_characters(encoder):
    library = Tokenizer.from_file(WORDS)
    text = "".join(map(chr, range(256))) + " " + " ".join(map(chr, range(33, 256)))
    for t in (text, text[::-1], *text):
        assert encoder.encode([t])[0] == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_counts_of_odd_documents(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts(odd_documents(spark), PIECES, limit=100, batch_bytes=20).collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in TEXTS]
    assert sorted(map(str, got)) == sorted(str(type(got[0])(**dict(zip(got[0].__fields__, (*w, w[2] > 100))))) for w in want)
    assert token_counts(no_documents(spark), PIECES).count() == 0
    with pytest.raises(ValueError):
        token_counts(odd_documents(spark), PIECES, keep=("doc_id", "n_tokens"))


def test_packing_odd_documents(spark):
    library = Tokenizer.from_file(WORDS)
    packed = packing.pack_documents(odd_documents(spark), WORDS, capacity=64, with_ids=True, batch_bytes=20)
    rows = packed.collect()
    want = []
    for i, t, *_ in TEXTS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at : at + 64], "<u4")
            want.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    check_places([(r.sequence_id, r.offset, r.length) for r in rows], 64)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert packing.pack_documents(no_documents(spark), WORDS).count() == 0


def check_places(places, capacity):
    by = {}
    for sequence, offset, length in places:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30), st.integers(1, 40))
def test_plan_uses_every_piece_once(counts, groups):
    bins = packing.plan(counts, 64, groups=groups)
    used = {}
    for content, times in bins:
        assert times > 0 and sum(content) <= 64
        for n in content:
            used[n] = used.get(n, 0) + times
    assert used == counts


def test_plan_is_near_the_bound():
    draw = random.Random(3)
    counts = {}
    for _ in range(20_000):
        n = min(2048, int(draw.lognormvariate(6, 1.2)) + 1)
        counts[n] = counts.get(n, 0) + 1
    bins = packing.plan(counts, 2048)
    assert sum(t for _, t in bins) <= 1.005 * -(-sum(n * c for n, c in counts.items()) // 2048)


def test_a_hot_length_is_ranked_over_many_salts(spark):
    cut = spark.range(3000).selectExpr("id", "cast(if(id % 3 = 0, id % 50 + 1, 40) as long) as length")
    rows = packing.pack(cut, capacity=100, salts=16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3000
    n = check_places([(r.sequence_id, r.offset, r.length) for r in rows], 100)
    assert n <= 1.02 * best_fit_decreasing([r.length for r in rows], 100)


def best_fit_decreasing(lengths, capacity):
    rooms = [0] * (capacity + 1)
    for n in sorted(lengths, reverse=True):
        fit = next((r for r in range(n, capacity + 1) if rooms[r]), None)
        if fit is not None:
            rooms[fit] -= 1
        rooms[(fit or capacity) - n] += 1
    return sum(rooms)


@pytest.mark.parametrize("kind", ["日本語中文漢字、。！", "0123456789abcdef", "aé日.,;\n\t(){}", "абвгд日、ーІЇ", "é́ﬁ½aA"])
def test_long_parts_without_spaces(kind):
    counter, r = PieceCounter(PIECES), random.Random(5)
    for n in (4095, 4097, 30_000):
        text = "".join(r.choice(kind) for _ in range(n))
        for t in (text, "a " + text + " b", " " + text):
            assert counter.count([t]) == [len(counter.model.encode(t))]
    assert all(len(p) <= 64 for p in counter.known)


def test_caches_hold_few_bytes():
    """Whole texts without spaces are not remembered, many words only up to the bound, and nothing after a task."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(60_000)]
    blobs = ["".join(r.choice("0123456789abcdef") for _ in range(5000)) for _ in range(20)]
    for coder, run in ((PieceCounter(PIECES, memory=1 << 20), "count"), (packing.WordEncoder(WORDS, memory=1 << 20), "encode")):
        fresh = type(coder)(PIECES if run == "count" else WORDS, memory=1 << 30)
        texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)] + blobs
        assert getattr(coder, run)(texts) == getattr(fresh, run)(texts)
        assert getattr(coder, run)(texts[::-1]) == getattr(coder, run)(texts)[::-1]
        assert 1 << 20 <= coder.held < 3 << 20 and len(coder.known) < 20_000
        assert max(map(len, coder.known)) <= 64
        coder.forget()
        assert not coder.known and not coder.held
