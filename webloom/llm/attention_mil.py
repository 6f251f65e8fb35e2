"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_BYTES bytes. Every passage is encoded: counts of hashed
byte trigrams (square roots, unit length) and a few shares of character classes. The model maps a
passage x to h = tanh(x E + e), weighs it by gated attention
a ~ exp(w . (tanh(V h) * sigmoid(U h))), and scores the document by a logistic function of the
weighted sum of its h. All weights are learned together from the documents' labels by Adam.

``MAX_LABELLED`` bounds the labelled documents that train; which ones is fixed by a hash of doc_id. Of those
the ones of more than ``MAX_LABELLED_BYTES`` don't train (their labels count for the mean), so what comes to the driver is bounded in bytes too.
Scoring reads every passage of every document in one pass without a shuffle.

Defined cases: null and empty texts are one empty passage, scored as such; labels that are null are
not used, repeated ones are averaged; with fewer than two classes to learn from every document scores
the mean label (0.5 without labels) and, as the threshold rejects only scores below it, an
unlabelled corpus is kept whole; repeated rows score alike; an empty table gives no rows; other
columns pass through ``kept`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import fresh, named, small_batches
from webloom.llm.wordpieces import flat_bytes, frugal

PASSAGE_BYTES = 640
BUCKETS = 256
HIDDEN = 24
MAX_LABELLED = 3000
MAX_LABELLED_BYTES = 64_000
EPOCHS = 120
THRESHOLD = 0.35

#: Character classes by byte: upper case, digit, white space, other ASCII signs, beyond ASCII.
_CLASSES = 5
_CLASS = np.full(256, 5, np.uint8)
_CLASS[65:91] = 0
_CLASS[48:58] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 2
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_CLASS[128:] = 4
WIDTH = BUCKETS + _CLASSES + 1


def passages(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, passages of each document, features by passage), some documents at a time."""
    raw, offsets = flat_bytes(text)
    at_once, d, n = 1_000_000, 0, len(offsets) - 1
    while d < n:
        upto = max(d + 1, int(np.searchsorted(offsets, offsets[d] + at_once, "right")) - 1)
        yield d, *encode(raw[offsets[d] : offsets[upto]], offsets[d : upto + 1] - offsets[d])
        d = upto


def encode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PASSAGE_BYTES))
    first = np.cumsum(count) - count
    rows = int(count.sum())
    doc = np.repeat(np.arange(len(size)), count)
    start = offsets[doc] + (np.arange(rows) - first[doc]) * PASSAGE_BYTES
    length = np.minimum(start + PASSAGE_BYTES, offsets[doc + 1]) - start
    out = np.zeros((rows, WIDTH), np.float32)
    if len(raw):
        row = np.repeat(np.arange(rows, dtype=np.int64), length)
        x = raw.astype(np.uint32)
        last = offsets[1:][size > 0] - 1
        x1 = np.append(x[1:], np.uint32(0))
        x1[last] = 0  # a document's features are its own
        x2 = np.append(x1[1:], np.uint32(0))
        x2[last] = 0
        h = x * np.uint32(2654435761) + x1 * np.uint32(2246822519) + x2 * np.uint32(3266489917)
        h ^= h >> np.uint32(15)
        h = h * np.uint32(668265263) >> np.uint32(24)
        grams = np.bincount(row * BUCKETS + h, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
        classes = np.bincount(row * 6 + _CLASS[raw], minlength=rows * 6).reshape(rows, 6)
        some = np.maximum(length, 1)[:, None]
        out[:, :BUCKETS] = np.sqrt(grams / some)
        out[:, BUCKETS:-1] = 2 * classes[:, :_CLASSES] / some
        out[:, -1] = np.minimum(length / PASSAGE_BYTES, 1)
    return count, out


@dataclass
class Model:
    E: np.ndarray  # WIDTH x HIDDEN
    e: np.ndarray
    V: np.ndarray  # HIDDEN x HIDDEN
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @classmethod
    def initial(cls, width: int, hidden: int, seed: int) -> Model:
        r = np.random.default_rng(seed)
        s = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        return cls(3 * s(width, hidden), np.zeros(hidden, np.float32), s(hidden, hidden), s(hidden, hidden), s(hidden), s(hidden), np.zeros(1, np.float32))

    def attend(self, x: np.ndarray, starts: np.ndarray, count: np.ndarray):
        """starts, count: the rows of each bag; every bag has one at least."""
        h = np.tanh(x @ self.E + self.e)
        t, g = np.tanh(h @ self.V), 1 / (1 + np.exp(-(h @ self.U)))
        s = (t * g) @ self.w
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), count))
        a = s / np.repeat(np.add.reduceat(s, starts), count)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.b, -30, 30)))
        return h, t, g, a, z, p

    def gradient(self, x: np.ndarray, starts: np.ndarray, count: np.ndarray, y: np.ndarray, decay: float) -> list[np.ndarray]:
        h, t, g, a, z, p = self.attend(x, starts, count)
        dlogit = ((p - y) / len(y)).astype(np.float32)
        dz = np.repeat(dlogit[:, None] * self.c, count, axis=0)
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), count))
        dt, dg = ds[:, None] * g * self.w, ds[:, None] * t * self.w
        dv, du = dt * (1 - t * t), dg * g * (1 - g)
        dh = a[:, None] * dz + dv @ self.V.T + du @ self.U.T
        dpre = dh * (1 - h * h)
        grads = [x.T @ dpre, dpre.sum(0), h.T @ dv, h.T @ du, (t * g).T @ ds, z.T @ dlogit, dlogit.sum(keepdims=True)]
        return [d + decay * getattr(self, f.name) if f.name in "EVU" else d for d, f in zip(grads, fields(self))]


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, *, hidden: int = HIDDEN, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-4, batches: int = 4, seed: int = 7) -> Model:
    model = Model.initial(x.shape[1], hidden, seed)
    names = [f.name for f in fields(model)]
    m, v = ([np.zeros_like(getattr(model, n)) for n in names] for _ in range(2))
    starts = np.cumsum(count) - count
    parts = [np.arange(i, len(y), batches) for i in range(min(batches, len(y)))]
    cut = [(np.concatenate([np.arange(starts[d], starts[d] + count[d]) for d in p]), count[p]) for p in parts]
    held = [(x[rows], np.cumsum(c) - c, c, y[p]) for (rows, c), p in zip(cut, parts)]
    step = 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs) + 1e-4
        for xb, sb, cb, yb in held:
            step += 1
            for i, (n, d) in enumerate(zip(names, model.gradient(xb, sb, cb, yb, decay))):
                m[i] += 0.1 * (d - m[i])
                v[i] += 0.01 * (d * d - v[i])
                getattr(model, n).__isub__((lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32))
    return model


def score_batch(model: Model | None, mean: float, text: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(text), mean)
    out = np.zeros(len(text))
    for d, count, x in passages(text):
        out[d : d + len(count)] = model.attend(x, np.cumsum(count) - count, count)[-1]
    return out


def scorer(model: Model | None, mean: float):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            yield pa.array(score_batch(model, mean, text), pa.float64())

    return F.arrow_udf(frugal(run), T.DoubleType())


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_labelled: int = MAX_LABELLED) -> tuple[Model | None, float]:
    """The model, or None with the score that then holds for all. Encoded passages, not texts, come
    to the driver: at most max_labelled documents of them."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.select(named(labels, "doc_id").alias("doc_id"), named(labels, label).cast("double").alias("y"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.avg("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    text = docs.select(named(docs, "doc_id").alias("doc_id"), named(docs, "text").alias("text"))
    long = F.coalesce(F.octet_length("text") > MAX_LABELLED_BYTES, F.lit(False))
    text = text.withColumn("long", long).withColumn("text", F.when(~F.col("long"), F.col("text")))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, count, x in passages(batch.column("text")):
                ends = np.cumsum(count)
                rows = batch.slice(d, len(count))
                bags = [None if no else x[b - n : b].astype(np.float16).tobytes() for n, b, no in zip(count, ends, rows.column("long").to_pylist())]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("y"), pa.array(bags, pa.binary())], names=["doc_id", "y", "x"])

    rows = text.join(F.broadcast(chosen), "doc_id").mapInArrow(encoded, "doc_id long, y double, x binary").toArrow()
    ids, y = (np.asarray(rows.column(c)) for c in ("doc_id", "y"))
    if not len(y):
        return None, 0.5
    mean, bags = float(y.mean()), rows.column("x").to_pylist()
    some = np.array([b is not None for b in bags])
    if (y[some] < 0.5).all() or (y[some] >= 0.5).all():
        return None, mean
    ids, y, bags = ids[some], y[some], [b for b in bags if b is not None]
    order = sorted(range(len(y)), key=lambda i: (ids[i], y[i], bags[i]))
    xs = [np.frombuffer(bags[i], np.float16).reshape(-1, WIDTH).astype(np.float32) for i in order]
    return fit(np.concatenate(xs), np.array([len(x) for x in xs]), y[order].astype(np.float32)), mean


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, score (that the document is good) and keep, for every document."""
    model, mean = train(docs, labels, max_labelled=max_labelled)
    rows = docs.select(named(docs, "doc_id").alias("doc_id"), scorer(model, mean)(named(docs, "text")).alias("score"))
    return rows.withColumn("keep", F.col("score") >= (threshold if model else 0.0))


def kept(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    model, mean = train(docs, labels, max_labelled=max_labelled)
    if model is None:
        return docs
    s = fresh(docs, "score")
    out = docs.withColumn(s, scorer(model, mean)(named(docs, "text")))
    return out.filter(out[s] >= threshold).select(*(named(out, c) for c in docs.columns))
