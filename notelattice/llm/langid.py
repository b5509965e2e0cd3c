"""Language identification by nearest centroid.

A text is the vector of its character n-grams (1 to ``max_n``): letters lower-cased, everything else one space, counts
hashed into buckets, damped by a logarithm, weighted by inverse document frequency and normalised. Every language has
several centroids, found by spherical k-means on its own training vectors, so that different kinds of text of one
language needn't share a mean. The label of the nearest centroid by cosine wins, the smaller label on a tie.

Rejection is by distance: a text is rejected when its best cosine is below what labelled texts of about its length
show that didn't teach. Every fold of the training texts is compared with the centroids of the other folds, and the
limit of a length class is ``quantile`` of these cosines times ``slack``, so that single odd texts don't set it. A class
of fewer than ``FEW`` texts doesn't know its quantile and has half of the limit. Cosines of short texts spread so much
that those of labelled texts and of noise overlap; they have ``SHORT_SLACK``. The final centroids learn from all.

Training takes at most ``max_sample`` distinct labelled texts, spread evenly over the labels by a hash of the text,
as a whole, and only their bucket counts reach the driver (``BUCKETS`` at most per row). Prediction reads every whole text
in Arrow functions; the model it carries has ``features`` numbers per centroid.

Defined cases: a null text or one without a letter is ``und`` with score 0 and is rejected. Labels that are null
don't teach. With no labelled row at all everything is ``und``. Rows are independent of each other, so repeated rows
and batches don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.llm.common import check_columns, release_memory, ship, text_batches, with_text

UNDETERMINED = "und"
BUCKETS = 1 << 16
SPACE = 32
#: Classes of text length for rejection, how many texts a class must have for its full limit, and folds for calibration.
LENGTHS, FEW, FOLDS = [0, 40, 200, 1000], 15, 4
#: Shorter texts are rejected below this share of the quantile.
SHORT, SHORT_SLACK = 200, 0.5


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


def grams(texts: list[str], max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams of all texts. The work is a few passes over all characters at once."""
    lowered = [t.lower() for t in texts]
    joined = "".join([f" {t} " for t in lowered])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    sizes = np.array([len(t) + 2 for t in lowered], np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    points = np.where(letters()[points], points, SPACE)
    again = np.zeros(len(points), bool)
    again[1:] = (points[1:] == SPACE) & (points[:-1] == SPACE) & (row[1:] == row[:-1])
    points, row = points[~again].astype(np.uint32), row[~again]
    rows, found = [], []
    code = np.zeros(len(points), np.uint32)
    for n in range(1, max_n + 1):
        if len(points) < n:
            break
        last = len(points) - n + 1
        code = code[:last] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(1)
        mixed = (code ^ code >> np.uint32(15)) * np.uint32(0x85EBCA6B)
        inside = row[:last] == row[n - 1 :]
        if n == 1:
            inside &= points != SPACE
        rows.append(row[:last][inside])
        found.append((mixed >> np.uint32(16))[inside])
    return np.concatenate(rows or [row]), np.concatenate(found or [points]).astype(np.int32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Centroids and what is needed to compare a text with them."""

    def __init__(self, max_n: int, chosen: np.ndarray, idf: np.ndarray, centroids: np.ndarray, labels: list[str]):
        self.max_n, self.idf, self.centroids, self.labels = max_n, idf, centroids, labels
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[chosen] = np.arange(len(chosen))
        self.limits: list[tuple[int, float]] = []  # (from so many letters on, least cosine)

    def vectors(self, texts: list[str]) -> np.ndarray:
        row, bucket = grams(texts, self.max_n)
        at = self.place[bucket]
        known = at >= 0
        width = len(self.idf)
        counts = np.bincount(row[known].astype(np.int64) * width + at[known], minlength=len(texts) * width)
        return weighted(counts.reshape(len(texts), width), self.idf)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Label, cosine and rejection of every text."""
        labels, scores, out = [], [], []
        for begin in range(0, len(texts), 64):
            block = texts[begin : begin + 64]
            cosines = self.vectors(block) @ self.centroids.T
            best = cosines.argmax(axis=1) if self.labels else np.zeros(len(block), int)
            for i, text in enumerate(block):
                if not self.labels or not has_letter(text):
                    labels.append(UNDETERMINED)
                    scores.append(0.0)
                    out.append(True)
                    continue
                score = round(float(min(1.0, max(0.0, cosines[i, best[i]]))), 6)
                labels.append(self.labels[best[i]])
                scores.append(score)
                out.append(score < self.limit(len(text)))
        return labels, scores, out

    def limit(self, length: int) -> float:
        return max((x for x in self.limits if x[0] <= length), default=(0, 0.0))[1]


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    found = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt((found * found).sum(axis=1, keepdims=True))
    return found / np.where(norm > 0, norm, 1)


def clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the mean's nearest vector and then always the farthest one."""
    mean = vectors.mean(axis=0)
    chosen = [int((vectors @ mean).argmax())]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(axis=1).argmin()))
    centers = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        sums = np.stack([vectors[own == i].sum(axis=0) for i in range(len(centers))])
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
    return centers


def centers(vectors: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, list[str]]:
    """Up to ``k`` centroids of every label, and their labels."""
    names = sorted(set(label))
    made = [clustered(vectors[label == name], k) for name in names]
    return np.concatenate(made).astype(np.float32), [n for n, c in zip(names, made, strict=True) for _ in c]


def sample(docs: DataFrame, text_col: str, label_col: str, max_sample: int) -> DataFrame:
    """At most ``max_sample`` distinct labelled texts, as many of each label as there are, up to an equal share.

    A text is drawn by its own hash, so copies are drawn together and count once, and no label is sorted. The
    distinct texts of a label are estimated with a combine before the shuffle; texts move only when they are drawn.
    """
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(
        F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(text_col).alias("hash")
    )
    sizes = labelled.groupBy("label").agg(F.approx_count_distinct("hash").alias("n"))
    sizes = sizes.orderBy(F.desc("n"), "label").limit(max_sample).collect()
    if not sizes:
        return labelled.limit(0).select("text", "label")
    share = max_sample / len(sizes)
    rates = labelled.sparkSession.createDataFrame(
        [(x["label"], min(1.0, share / max(1, x["n"]))) for x in sizes], "label string, rate double"
    )
    place = F.pmod(F.col("hash"), F.lit(1 << 30)) / (1 << 30)
    drawn = labelled.join(F.broadcast(rates), "label").where(place <= F.col("rate"))  # max_sample rows at most
    drawn = drawn.groupBy("label", "hash").agg(F.min("text").alias("text"))
    return drawn.orderBy(F.xxhash64("hash", F.lit(1)), "label").limit(max_sample).select("text", "label")


def fit(
    docs: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    max_sample: int = 1600,
    max_n: int = 3,
    features: int = 4096,
    centroids: int = 4,
    slack: float = 0.77,
    quantile: float = 0.01,
) -> Model:
    """A model from a bounded sample of the labelled rows."""
    check_columns(docs, [text_col, label_col], [])
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text", 1 << 18):
            row, bucket = grams(texts, max_n)
            keys, n = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            cut = np.searchsorted(keys, np.arange(1, len(texts)) * BUCKETS)
            ids, ns = np.split((keys % BUCKETS).astype(np.int32), cut), np.split(n.astype(np.int32), cut)
            kind = pa.list_(pa.int32())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), sizes, pa.array(ids, kind), pa.array(ns, kind)],
                names=["label", "size", "ids", "ns"],
            )

    schema = "label string, size long, ids array<int>, ns array<int>"
    rows = sample(docs, text_col, label_col, max_sample).mapInArrow(counted, schema).toArrow().to_pydict()
    n = len(rows["label"])
    found = np.zeros(BUCKETS, np.int64)
    for ids in rows["ids"]:
        found[ids] += 1
    chosen = np.sort(np.argsort(-found, kind="stable")[:features])
    chosen = chosen[found[chosen] > 0]
    idf = (np.log((1 + n) / (1 + found[chosen])) + 1).astype(np.float32)
    model = Model(max_n, chosen, idf, np.zeros((0, len(chosen)), np.float32), [])
    if not n or not len(chosen):
        return model
    counts = np.zeros((n, len(chosen)), np.float32)
    for i, (ids, ns) in enumerate(zip(rows["ids"], rows["ns"], strict=True)):
        at = model.place[ids]
        counts[i, at[at >= 0]] = np.array(ns)[at >= 0]
    vectors = weighted(counts, idf)
    useful = vectors.any(axis=1)
    vectors, label = vectors[useful], np.array(rows["label"], dtype=object)[useful]
    size = np.array(rows["size"])[useful]
    if not len(label):
        return model
    model.centroids, model.labels = centers(vectors, label, centroids)
    # Folds within each label, in the order of the sample, which is that of a hash.
    fold = np.zeros(len(label), int)
    for name in set(label):
        fold[label == name] = np.arange((label == name).sum()) % FOLDS
    best = np.full(len(label), np.nan)
    for f in range(FOLDS):
        out = fold == f
        if out.any() and not out.all():
            best[out] = (vectors[out] @ centers(vectors[~out], label[~out], centroids)[0].T).max(axis=1)
    for low, high in zip(LENGTHS, [*LENGTHS[1:], 1 << 62], strict=True):
        near = best[(size >= low) & (size < high) & ~np.isnan(best)]
        if len(near):
            share = (slack if low >= SHORT else SHORT_SLACK) * (1 if len(near) >= FEW else 0.5)
            model.limits.append((low, share * float(np.quantile(near, quantile))))
    return model


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), batch_bytes: int = 1 << 18
) -> DataFrame:
    """``keep`` with ``lang_pred``, ``score`` (cosine of the nearest centroid) and ``rejected``."""
    check_columns(docs, [text_col], ["lang_pred", "score", "rejected"])
    check_columns(docs, list(keep), ["lang_pred", "score", "rejected"])
    ship(docs.sparkSession)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text_col, batch_bytes):
            labels, scores, out = model.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(labels), pa.array(scores), pa.array(out)],
                names=[*keep, "lang_pred", "score", "rejected"],
            )
        release_memory()

    schema = f"{types}, lang_pred string, score double, rejected boolean"
    return with_text(docs, keep, text_col).mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    """Rows whose CRC-32 of the id falls into ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
