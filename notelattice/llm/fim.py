"""Fill-in-middle transformation with a learned rank index.

A text is cut between units, each a word with the white space before it (or white space at the end). All unit ends of a
block of texts are kept as a piecewise-linear function of their rank: a segment grows while one slope stays within
``bound`` characters of every end, and what the slope misses is stored as one signed byte per end. A cut is a rank; its
offset is the segment's prediction plus the stored residual, so it is exact. A block has about ``batch_bytes`` of texts
or one longer text, whose ends are found and fitted chunk by chunk, so memory beyond the text is a byte or so per unit.

Cuts, form and order of the parts are drawn from a hash of the seed and the id, so a repeated task gives the same
output. The parts are ``<P>`` prefix, ``<S>`` suffix, ``<M>`` middle; texts that hold one of the marks stay plain, so
that ``restored`` finds the text again.

Defined cases: null and empty texts are plain, empty and have 0 units. A null id is hashed as an empty one. Rows are
independent, so repeated rows give equal outputs. Only the columns in ``keep`` are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.llm.common import check_columns, ship, text_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK = 1 << 20  # characters whose unit ends are found at once
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def unit_ends(text: str, ends: np.ndarray, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """Offsets behind every unit of several joined texts, ascending, chunk by chunk. ``ends``: where each text ends."""
    for at in range(0, len(text), chunk):
        codes = np.frombuffer(text[at : at + chunk + 1].encode("utf-32-le"), "<u4")
        space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
        size = min(chunk, len(text) - at)
        stops = ~space[:size]
        stops[: len(space) - 1] &= space[1:]
        stops[ends[(ends > at) & (ends <= at + size)] - 1 - at] = True
        yield np.flatnonzero(stops) + (at + 1)


class RankIndex:
    """Ascending whole numbers by rank, as error-bounded line segments with residuals."""

    def __init__(self, bound: int = 100):
        if not 0 < bound <= 120:
            raise ValueError("residuals are kept in one byte")
        self.bound, self.n = bound, 0
        self._first: list[int] = []  # rank of the first point of each segment
        self._base: list[int] = []  # its value, which every segment hits
        self._slope: list[float] = []
        self._residuals: list[np.ndarray] = []

    def extend(self, values: np.ndarray) -> None:
        """Add values, none below those added before."""
        at, last, guess = 0, len(values) - 1, 256
        begin = len(self._first)
        while at <= last:
            take = min(guess, last - at)
            while True:
                rise = values[at + 1 : at + 1 + take] - values[at]
                steps = np.arange(1, take + 1)
                low = np.maximum.accumulate((rise - self.bound) / steps)
                high = np.minimum.accumulate((rise + self.bound) / steps)
                apart = low > high
                length = int(apart.argmax()) if apart.any() else take
                if length < take or at + take == last:
                    break
                take = min(2 * take, last - at)
            self._first.append(self.n + at)
            self._base.append(int(values[at]))
            self._slope.append(float(low[length - 1] + high[length - 1]) / 2 if length else 0.0)
            at += length + 1
            guess = min(max(64, 2 * length), 1 << 16)
        ranks = np.arange(self.n, self.n + len(values))
        missed = values - self._predict(ranks, begin)
        self._residuals.append(missed.astype(np.int8))
        self.n += len(values)

    def _predict(self, ranks: np.ndarray, begin: int = 0) -> np.ndarray:
        first = np.array(self._first[begin:], np.int64)
        segment = np.searchsorted(first, ranks, "right") - 1
        slope, base = np.array(self._slope[begin:])[segment], np.array(self._base[begin:], np.int64)[segment]
        return base + np.rint(slope * (ranks - first[segment])).astype(np.int64)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        """The values of these ranks, exactly."""
        if not len(ranks):
            return np.zeros(0, np.int64)
        if len(self._residuals) > 1:
            self._residuals = [np.concatenate(self._residuals)]
        return self._predict(ranks) + self._residuals[0][ranks]

    @property
    def n_segments(self) -> int:
        return len(self._first)


def draws(seed: int, row_id: object) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))  # type: ignore[return-value]


def _arranged(texts: list[str], ids: list[object], seed: int, rate: int, spm_rate: int, bound: int) -> list[tuple]:
    """``ADDED`` of every text of a block."""
    ends = np.cumsum([len(t) for t in texts])
    index = RankIndex(bound)
    index.extend(np.zeros(1, np.int64))
    last_rank = np.zeros(len(texts), np.int64)
    for found in unit_ends("".join(texts), ends):
        last_rank += np.searchsorted(found, ends, "right")
        index.extend(found)
    first_rank = np.concatenate([[0], last_rank[:-1]])
    units = (last_rank - first_rank).tolist()

    out: list[tuple] = []
    cut: list[int] = []
    ranks: list[tuple[int, int]] = []
    forms: list[str] = []
    for i, (text, n, row_id) in enumerate(zip(texts, units, ids, strict=True)):
        h1, h2, h3, h4 = draws(seed, row_id)
        if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            continue
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        cut.append(i)
        ranks.append((a, b))
        forms.append("spm" if h4 % 100 < spm_rate else "psm")
    offsets = index.at((np.array(ranks, np.int64).reshape(-1, 2) + first_rank[cut, None]).ravel()).reshape(-1, 2)
    starts = np.concatenate([[0], ends[:-1]])[cut]
    places = dict(zip(cut, zip(forms, (offsets - starts[:, None]).tolist(), strict=True), strict=True))
    for i, (text, n) in enumerate(zip(texts, units, strict=True)):
        if i not in places:
            out.append((n, "plain", None, None, text))
            continue
        form, (a, b) = places[i]
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if form == "psm":
            made = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
        else:
            made = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        out.append((n, form, a, b - a, made))
    return out


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    seed: int = 42,
    rate: int = 50,
    spm_rate: int = 80,
    bound: int = 100,
    batch_bytes: int = 1 << 20,
) -> DataFrame:
    """``keep`` with ``n`` units, ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` in a hundred texts are rearranged, ``spm_rate`` in a hundred of those with the suffix first.
    """
    check_columns(docs, [id_col, text_col, *keep], ADDED)
    ship(docs.sparkSession)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema = f"{types}, n long, form string, prefix_chars long, middle_chars long, output string"

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch, texts in text_batches(batches, text_col, batch_bytes):
            made = _arranged(texts, batch.column(id_col).to_pylist(), seed, rate, spm_rate, bound)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *ADDED])

    return docs.select(*dict.fromkeys([*keep, id_col, text_col])).mapInArrow(arrange, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of."""

    def part(n: int, before: str, text: Column | str = output) -> Column:
        return F.split_part(F.col(text) if isinstance(text, str) else text, F.lit(before), F.lit(n))

    middle = part(2, MIDDLE)
    psm = F.concat(part(2, PREFIX, part(1, SUFFIX)), middle, part(1, MIDDLE, part(2, SUFFIX)))
    spm = F.concat(part(1, MIDDLE, part(2, PREFIX)), middle, part(2, SUFFIX, part(1, PREFIX)))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
