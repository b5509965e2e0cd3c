"""Packing documents into sequences: linear grouping, configurations, best fit for the small ones.

1. Documents become pieces of at most ``capacity`` tokens; only longer ones are cut. Arrow functions return lengths and
   checksums, so nothing larger is stored or shuffled.
2. Lengths are whole numbers up to the capacity, so a histogram describes any corpus in at most ``capacity`` rows.
   That is all the driver sees, and the plan made of it is bounded by capacity and ``groups`` alone:
   large lengths are rounded up within groups of equal cardinality; configurations of these few sizes are optimised
   one after the other (the largest size left, filled up by an exact subset sum, repeated as often as supplies last);
   actual lengths are substituted for the rounded ones, longest first; small lengths then go best-fit, longest first,
   into what is left, and into new sequences at last.
3. The plan says for every length which ranks go where. Pieces get a rank within their length by a count per
   (length, salt) and a number within it, so a length that a third of all pieces have is spread over all tasks.

Defined cases: a null text is an empty one and makes one piece with the end token alone. Repeated rows are packed each.
No rows give no sequences. Only the columns in ``keep`` are carried along.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from notelattice.llm.common import check_columns, release_memory, ship, stored, text_batches, with_text

#: Fixed values of the tokenizer file for which whole words may be looked up.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: The same pattern for lower-case Latin-1.
LATIN_WORD = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+"
)
#: Control characters, on which engines differ about what is white space, and the soft hyphen.
UNSURE = bytes([*range(0x09), *range(0x0E, 0x20), *range(0x7F, 0xA0), 0xAD])


#: Bytes of remembered words, what one takes besides its own and its ids' bytes, and the longest one in characters.
WORD_BYTES, WORD_COST, LONGEST = 32 << 20, 190, 64


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to those of the tokenizer file.

    Where the file lower-cases, drops white space and cuts words before it merges, a word's ids don't depend on its
    neighbours. Latin-1 texts are then split into words, which are encoded once and remembered: those met first, which
    the frequent ones are among, until they take ``memory`` bytes; never words above LONGEST characters. Words beyond
    that are encoded for each batch anew. All other texts and files go through the library as they are.
    """

    def __init__(self, path: str, memory: int = WORD_BYTES):
        self.path, self.memory, self.held = path, memory, 0
        self.known: dict[str, bytes] = {}
        self.merger = Tokenizer.from_file(path)
        kinds = [type(x).__name__ for x in self.merger.normalizer] if self.merger.normalizer else []
        self.by_word = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and json.dumps(WORD_PATTERN) in json.dumps(_state(self.merger.pre_tokenizer), ensure_ascii=False)
            and getattr(self.merger.model, "end_of_word_suffix", None) == WORD_END
            and all(x.content.startswith("<|") for x in self.merger.get_added_tokens_decoder().values())
        )
        if self.by_word:
            self.merger.normalizer = normalizers.Sequence([])
            self.merger.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            self.ends = np.zeros(self.merger.get_vocab_size(), bool)
            for i in range(len(self.ends)):
                self.ends[i] = (self.merger.id_to_token(i) or "").endswith(WORD_END)

    @cached_property
    def whole(self) -> Tokenizer:
        """The library as it is; loaded when the first text needs it."""
        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        """Give the remembered words' memory back, at the end of a task."""
        self.known.clear()
        self.held = 0

    def _learn(self, words: list[str]) -> list[str]:
        """Ids of new words; returns those that are not to be remembered."""
        known, passing = self.known, []
        for begin in range(0, len(words), 5_000):
            block = words[begin : begin + 5_000]
            ids = np.array(self.merger.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(block):
                raise ValueError("words and their ends don't agree")
            data, at = ids.tobytes(), 0
            full = self.held >= self.memory
            for word, stop in zip(block, (stops * 4).tolist(), strict=True):
                known[word] = data[at:stop]
                if full or len(word) > LONGEST:
                    passing.append(word)
                else:
                    self.held += WORD_COST + len(word) + stop - at
                at = stop
        return passing

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = [None] * len(texts)
        out = [b""] * len(texts)
        for i, text in enumerate(texts):
            if self.by_word and "<|" not in text:
                try:
                    raw = text.encode("latin-1")
                except UnicodeEncodeError:
                    continue
                if len(raw.translate(None, UNSURE)) == len(raw):
                    split[i] = LATIN_WORD.findall(text.lower())
        new = set().union(*(w for w in split if w is not None)).difference(self.known)
        passing = self._learn(list(new)) if new else []
        get = self.known.__getitem__
        for i, found in enumerate(split):
            if found is None:
                ids = self.whole.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids
                out[i] = np.array(ids, "<u4").tobytes()
            else:
                out[i] = b"".join(map(get, found))
        for word in passing:
            del self.known[word]
        return out


def _state(part: object) -> object:
    return json.loads(part.__getstate__()) if hasattr(part, "__getstate__") and part is not None else None


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker process, for the tokenizer file takes long to read; its words are forgotten after each task."""
    return WordEncoder(path)


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """``keep`` with ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` of every piece."""
    made = ["piece", "start", "length", "ids_crc32", "ids"]
    check_columns(docs, [text_col, *keep], made)
    ship(docs.sparkSession)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema = f"{types}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    last = int(end_id).to_bytes(4, "little")
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        encoder.forget()
        for batch, texts in text_batches(batches, text_col, batch_bytes):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, data in enumerate(encoder.encode(texts)):
                data += last
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            kept = batch.select(list(keep)).take(pa.array(row))
            columns = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            columns += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            names = [*keep, *made[: len(columns)]]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=names)
        encoder.forget()
        release_memory()

    return with_text(docs, keep, text_col).mapInArrow(cut, schema)


# ---- the plan, from a histogram alone ----


def linear_groups(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths, longest first, in at most about ``groups`` groups of equal cardinality (of pieces, not of lengths)."""
    share = max(1, -(-sum(counts.values()) // groups))
    found: list[list[int]] = []
    held = share
    for length in sorted(counts, reverse=True):
        if held >= share:
            found.append([])
            held = 0
        found[-1].append(length)
        held += counts[length]
    return found


def best_filling(capacity: int, supplies: list[tuple[int, int]]) -> list[int]:
    """Sizes out of ``supplies`` (size, count), largest first, with the largest sum up to ``capacity``.

    Subset sums are bits of one number per item; an item is taken only if the sum can't be had without it.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, items = [1], []
    for size, count in supplies:
        for _ in range(min(count, capacity // size)):
            now = (reach[-1] | reach[-1] << size) & mask
            if now == reach[-1]:
                break
            reach.append(now)
            items.append(size)
        if reach[-1] >> capacity:
            break
    left, chosen = reach[-1].bit_length() - 1, []
    for i in range(len(items), 0, -1):
        if not reach[i - 1] >> left & 1:
            chosen.append(items[i - 1])
            left -= items[i - 1]
    return chosen[::-1]


def configurations(sizes: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(sizes, times) until all are used: the largest left with its best filling, as often as supplies last."""
    left, found = dict(sizes), []
    order = sorted(sizes, reverse=True)
    while order:
        first = order[0]
        supplies = [(s, left[s] - (s == first)) for s in order if s <= capacity - first]
        chosen = [first, *best_filling(capacity - first, [x for x in supplies if x[1]])]
        times = min(left[s] // chosen.count(s) for s in set(chosen))
        found.append((chosen, times))
        for s in chosen:
            left[s] -= times
        order = [s for s in order if left[s]]
    return found


def substituted(
    found: list[tuple[list[int], int]], groups: list[list[int]], counts: dict[int, int]
) -> list[tuple[list[int], int]]:
    """Configurations with actual lengths for the rounded ones, longest first; parts of equal content stay together."""
    supply = {g[0]: [[length, counts[length]] for length in g] for g in groups}
    out = []
    for chosen, times in found:
        # What each slot gets, as runs along the repetitions.
        slots = []
        for size in chosen:
            runs, need = [], times
            while need:
                length, have = supply[size][0]
                n = min(have, need)
                runs.append((length, n))
                need -= n
                supply[size][0][1] -= n
                if not supply[size][0][1]:
                    supply[size].pop(0)
            slots.append(runs)
        cuts = sorted({c for runs in slots for c in np.cumsum([n for _, n in runs]).tolist()})
        at = 0
        index, until = [0] * len(slots), [runs[0][1] for runs in slots]
        for cut in cuts:
            out.append(([runs[k][0] for runs, k in zip(slots, index, strict=True)], cut - at))
            at = cut
            for j, runs in enumerate(slots):
                if until[j] == cut and index[j] + 1 < len(runs):
                    index[j] += 1
                    until[j] += runs[index[j]][1]
    return out


def fill_small(
    bins: list[tuple[list[int], int]], small: dict[int, int], capacity: int
) -> list[tuple[list[int], int]]:
    """Small lengths, longest first, each into the sequences with the least room that fits, then into new ones."""
    rooms: dict[int, list[tuple[list[int], int]]] = {}
    order: list[int] = []

    def put(content: list[int], times: int, room: int) -> None:
        if room not in rooms:
            insort(order, room)
            rooms[room] = []
        rooms[room].append((content, times))

    for content, times in bins:
        put(content, times, capacity - sum(content))
    for length in sorted(small, reverse=True):
        need = small[length]
        while need:
            k = bisect_left(order, length)
            if k == len(order):
                each = min(capacity // length, need)
                n = need // each
                put([length] * each, n, capacity - each * length)
            else:
                room = order[k]
                content, times = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(k)
                each = min(room // length, need)
                n = min(times, need // each)
                put(content + [length] * each, n, room - each * length)
                if times > n:
                    put(content, times - n, room)
            need -= n * each
    return [x for room in order for x in rooms[room]]


def plan(counts: dict[int, int], capacity: int, groups: int = 1024, small: int | None = None) -> list:
    """(lengths in a sequence, number of such sequences) for a histogram of lengths."""
    small = capacity // 16 if small is None else small
    large = {n: c for n, c in counts.items() if n > small}
    grouped = linear_groups(large, groups)
    rounded = {g[0]: sum(counts[n] for n in g) for g in grouped}
    bins = substituted(configurations(rounded, capacity), grouped, counts)
    return fill_small(bins, {n: c for n, c in counts.items() if n <= small}, capacity)


def slots(bins: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Arrays (length, first rank, first sequence, offset), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for content, times in bins:
        at = 0
        for length in content:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, at))
            used[length] = rank + times
            at += length
        sequence += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def ranked(cut: DataFrame, order: list[str], salts: int | None = None) -> DataFrame:
    """Adds ``_rank`` (from 0, without gaps) within a length."""
    total = cut.count() if salts is None else 0
    salts = salts or max(64, total // 50_000)
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    inside = Window.partitionBy("length", "_salt").orderBy(*order)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    starts = sums.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = salted.withColumn("_number", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["length", "_salt"]).withColumn("_rank", F.col("_start") + F.col("_number"))


def pack(cut: DataFrame, capacity: int = 2048, groups: int = 1024, salts: int | None = None) -> DataFrame:
    """``cut`` (stored pieces with ``length``) with ``sequence_id`` and ``offset``."""
    check_columns(cut, ["length"], [])
    histogram = cut.groupBy("length").count().collect()  # at most `capacity` rows
    if any(not 0 < x["length"] <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    length, rank, sequence, offset = slots(plan({x["length"]: x["count"] for x in histogram}, capacity, groups))
    keys = length * (1 << 48) + rank
    names = cut.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("length").to_numpy().astype(np.int64) * (1 << 48)
            own += batch.column("_rank").to_numpy().astype(np.int64)
            slot = np.searchsorted(keys, own, side="right") - 1
            columns = [pa.array(sequence[slot] + own - keys[slot]), pa.array(offset[slot])]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*names, "sequence_id", "offset"])

    order = [c for c, kind in cut.dtypes if not kind.startswith(("map", "variant"))]
    located = ranked(cut, order, salts).select(*names, "_rank")
    return located.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, **options) -> DataFrame:
    """Pieces of ``docs`` with their places. ``options`` are those of ``pieces``."""
    return pack(stored(pieces(docs, tokenizer_path, capacity=capacity, **options), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, n_pieces)`` of pieces packed with their ids; a sequence is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    found = packed.groupBy("sequence_id").agg(parts.alias("_parts"))
    return found.select(
        "sequence_id", F.flatten(F.col("_parts.ids")).alias("ids"), F.size("_parts").alias("n_pieces")
    )
