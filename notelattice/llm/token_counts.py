"""Token counts of whole texts with a SentencePiece model, in Arrow functions that return lengths only.

Arrow batches are cut into encoder batches of about the same number of bytes, so a run of long texts doesn't become
one huge call. Texts are split at safe boundaries: a single space between two other characters starts a new word
piece in these models, and no vocabulary entry holds a space mark behind another character (checked when the model is
loaded), so the counts of the parts add up to the count of the text. Parts that were counted before are remembered
within a task, up to a number of bytes; only new ones go to the library.

Where a boundary isn't safe, that is in texts with several spaces in a row, at an end, or with the space mark itself,
the text is split only between two letters' words, and runs of spaces stay whole. A long part without spaces is cut
between characters that stand side by side in no vocabulary entry, at punctuation or a change of script for instance.

Defined cases: null and empty texts have 0 bytes and 0 tokens. Rows are independent, so ties and repeated rows don't
matter. Only the columns in ``keep`` are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelattice.llm.common import check_columns, ship, text_batches

SPACE_MARK = "▁"
#: One space with neither a space nor the space mark at its sides.
SAFE = re.compile(f"(?<=[^ {SPACE_MARK}]) (?=[^ {SPACE_MARK}])")


#: Bytes of remembered parts, what one takes besides its own bytes, and the longest one in characters.
PART_BYTES, PART_COST, LONGEST = 32 << 20, 150, 64
#: Parts above this are cut again, where no vocabulary entry can cross.
LONG_PART = 4096


class PieceCounter:
    """Counts tokens of texts, remembering the parts met first until they take ``memory`` bytes."""

    def __init__(self, model_path: str, memory: int = PART_BYTES):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.memory, self.held = memory, 0
        self.known: dict[str, int] = {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(SPACE_MARK in p[1:] and p.strip(SPACE_MARK) for p in pieces)
        #: Characters that stand side by side in some entry; between others no entry reaches across.
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def forget(self) -> None:
        """Give the remembered parts' memory back, at the end of a task."""
        self.known.clear()
        self.held = 0

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.splits:
            return [text]
        if "  " in text or SPACE_MARK in text or text[0] == " " or text[-1] == " ":
            return SAFE.split(text)
        return text.split(" ")

    def _long(self, part: str) -> int:
        """Tokens of a long part, in slices between characters that no entry joins.

        A slice's own leading space mark is an entry by itself, because none joins it to the slice's first character;
        it isn't counted, except for the first slice, where it belongs to the part.
        """
        total, begin = 0, 0
        for i in range(LONG_PART, len(part), 1):
            if i - begin < LONG_PART:
                continue
            pair = part[i - 1 : i + 1]
            if pair not in self.joined and " " not in pair and SPACE_MARK not in pair and SPACE_MARK + part[i] not in self.joined:
                total += len(self.model.encode(part[begin:i], num_threads=1)) - (begin > 0)
                begin = i
        return total + len(self.model.encode(part[begin:], num_threads=1)) - (begin > 0)

    def count(self, texts: list[str]) -> list[int]:
        split = [self.parts(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        known, passing = self.known, []
        for begin in range(0, len(new), 5_000):
            block = new[begin : begin + 5_000]
            short = [p for p in block if len(p) <= LONG_PART]
            counts = dict(zip(short, map(len, self.model.encode(short, num_threads=1)), strict=True))
            counts |= {p: self._long(p) for p in block if len(p) > LONG_PART}
            full = self.held >= self.memory
            for part, n in counts.items():
                known[part] = n
                if full or len(part) > LONGEST:
                    passing.append(part)
                else:
                    self.held += PART_COST + len(part)
        out = [sum(map(known.__getitem__, words)) for words in split]
        for part in passing:
            del known[part]
        return out


@lru_cache(maxsize=2)
def piece_counter(model_path: str) -> PieceCounter:
    """One per worker process; its parts are forgotten after each task."""
    return PieceCounter(model_path)


def token_counts(
    docs: DataFrame,
    model_path: str,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    limit: int = 4096,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """``keep`` columns with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``)."""
    check_columns(docs, [text_col, *keep], ["n_bytes", "n_tokens", "over_limit"])
    if text_col in keep:
        raise ValueError("the text isn't returned")
    ship(docs.sparkSession)
    kept = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_bytes long, n_tokens long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path)
        counter.forget()
        for batch, texts in text_batches(batches, text_col, batch_bytes):
            columns = [batch.column(c) for c in keep]
            sizes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes, pa.int64()), pa.array(counter.count(texts), pa.int64())],
                names=[*keep, "n_bytes", "n_tokens"],
            )
        counter.forget()

    counted = docs.select(*keep, text_col).mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
