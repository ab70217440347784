"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Words, pairs of neighbouring words, word shapes (letter case, closing
punctuation, length) and pairs of shapes with a mark for a repeated word are
hashed into one table of ``BUCKETS`` weights. The value of a feature is its
count over the number of words, so that a score is a sparse dot product: the
mean of the weights over the words of a text.

Training takes a sample of labelled documents of at most about ``rows``, drawn
by the hash of their id from all of them; scoring takes every document whole.
Null and empty texts, and texts of blanks, have no features and get the score
of the intercept; without any label all scores are 0.5. A document with several
labels counts as good if one says so; labels without an id or value are left
out. Columns to carry may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.frames import row_blocks, text_bytes
from tiersmith.llm.words import BLANKS, LOWER, hash_ranges, mix, word_ranges

BITS = 18
BUCKETS = 1 << BITS
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
EPOCHS = 4

_KIND = np.zeros(256, np.int64)
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(97, 123)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[128:] = 4
_PUNCTUATION = (_KIND == 0).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the rows its four buckets, and the offsets of the rows in the words."""
    low = LOWER[data]
    begins, ends = word_ranges(low, offsets, BLANKS)
    rows = np.searchsorted(begins, offsets)
    if len(begins) == 0:
        return np.zeros((0, 4), np.int64), rows
    words = hash_ranges(low, begins, ends)
    upper = np.concatenate([[0], np.cumsum(_KIND[data] == 1)])
    marks = np.concatenate([[0], np.cumsum(_PUNCTUATION[data])])
    size = ends - begins
    capitals, signs = upper[ends] - upper[begins], marks[ends] - marks[begins]
    closing = np.where(_PUNCTUATION[data[ends - 1]] > 0, data[ends - 1], 0).astype(np.int64)
    shape = (((_KIND[data[begins]] * 4 + np.minimum(capitals, 3)) * 4 + np.minimum(signs, 3)) * 256 + closing) * 4
    shape = (shape + np.digitize(size, [4, 9, 25])).astype(np.uint64)
    before, shape_before = np.roll(words, 1), np.roll(shape, 1)
    start = rows[:-1][rows[:-1] < len(words)]
    before[start], shape_before[start] = 0, 1 << 20
    again = (words == before).astype(np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    streams = [words, words + before * step, shape * np.uint64(3) + np.uint64(1) << np.uint64(32),
               (shape * step) ^ (shape_before << np.uint64(24)) ^ (again << np.uint64(60)) ^ np.uint64(7)]
    return np.stack([(mix(s) >> np.uint64(64 - BITS)).astype(np.int64) for s in streams], 1), rows


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sparse vector of each text: buckets and values."""
    for batch in batches:
        places, values = [], []
        for text in batch.column("text").to_pylist():
            raw = np.frombuffer((text or "").encode(), np.uint8)
            f, _ = features(raw, np.array([0, len(raw)]))
            at, n = np.unique_counts(f.ravel())
            places.append(at.astype(np.int32).tobytes())
            values.append((n / max(1, len(f))).astype(np.float32).tobytes())
        yield pa.record_batch([batch.column("label"), pa.array(places, pa.binary()), pa.array(values, pa.binary())],
                              names=["label", "places", "values"])


def leader(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept by follow-the-regularised-leader, one example after the other."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    order = np.random.default_rng(5)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for k in order.permutation(len(examples)).tolist():
            at, x, y = examples[k]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[at] = more
    w = weights(z, n)
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        rows: int = 5000) -> tuple[np.ndarray, float]:
    """Train on documents that have a label; at most about ``rows`` of them."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    known = known.join(docs.select(key).distinct(), key, "left_semi")
    n = known.count()
    spread = 1_000_000 * max(1, n // 1_000_000_000)  # finer where a millionth would be too coarse for the share
    share = int(min(1.0, rows / max(1, n)) * spread)
    drawn = F.broadcast(known.where(F.pmod(F.xxhash64(key), F.lit(spread)) < share))  # at most about ``rows``
    got = docs.select(key, F.col(text).alias("text")).join(drawn, key).select("label", "text").mapInArrow(
        _examples, "label int, places binary, values binary").toArrow()
    examples = [(np.append(np.frombuffer(p, np.int32), BUCKETS), np.append(np.frombuffer(v, np.float32), 1.0).astype(np.float64), y)
                for y, p, v in zip(*(got.column(c).to_pylist() for c in ("label", "places", "values")))]
    # the order in which rows arrive must not matter
    examples.sort(key=lambda e: (e[2], len(e[0]), e[0].tobytes(), e[1].tobytes()))
    return leader(examples)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score, the probability of label 1, for every row."""
    taken = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("v"))
    carried = "".join(f"`k{i}` {f.dataType.simpleString()}, " for i, f in enumerate(taken.schema.fields[:-1]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("v"))
            out = np.zeros(len(batch))
            for lo, hi in row_blocks(offsets):
                f, rows = features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                total = np.concatenate([[0], np.cumsum(weights[f].sum(1, dtype=np.float64))])
                out[lo:hi] = (total[rows[1:]] - total[rows[:-1]]) / np.maximum(1, np.diff(rows))
            p = 1 / (1 + np.exp(-np.clip(out + intercept, -35, 35)))
            yield pa.record_batch([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], "score"])

    return taken.mapInArrow(run, carried + "score double").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")
