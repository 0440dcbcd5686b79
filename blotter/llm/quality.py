"""Quality grades by ordinal cumulative-link regression on hashed text.

Graded ratings 0 < 1 < ... < K are modelled with one score per text (shared
weights over hashed byte 3-grams and a few shape measures) and ordered
thresholds: P(grade > k) = sigmoid(score - threshold_k).  The weights and the
thresholds (the first one and positive steps) are fitted together by gradient
descent on a bounded sample of rated texts; scoring covers every whole text,
one Arrow batch at a time.  The expected grade is the sum of the tail
probabilities; selection goes by one of them.

Ratings used by the query: 0 for quality 0, 1 for a good text that is toxic,
2 for a good text that isn't.  A text is kept if P(grade >= 1) reaches KEEP.

Defined cases: a null or empty text has no 3-gram and is scored by its shape;
unrated texts are scored like any other; ratings that are null or belong to
no text are ignored; repeated rows get equal scores; without ratings of at
least two grades every text is kept, at the rate of the grade seen (1 if none
is); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.common import boxed, text_of

BITS = 15
SHAPES = 8
SAMPLE = 3000        # rated texts fitted on, the first by hash of their id
LONGEST = 200_000    # bytes; longer texts are not fitted on (they are scored)
STEPS, RATE, RIDGE = 100, 0.5, 1e-4
GAIN = 10.0          # scale of the 3-gram shares
KEEP = 0.5
CHUNK = 1 << 19

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    weights: np.ndarray     # 2**BITS + SHAPES
    mean: np.ndarray        # of the shape measures
    scale: np.ndarray
    thresholds: np.ndarray  # ascending; empty if only one grade was seen
    only: float             # that grade


def gram_counts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of every byte 3-gram inside a text."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = _LOWER[data]
    code = (low[:-2] | (low[1:-1] << np.uint32(8)) | (low[2:] << np.uint32(16))) * np.uint32(2654435761)
    who = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = who[:-2] == who[2:]
    return (code[inside] >> np.uint32(32 - BITS)).astype(np.int64), who[:-2][inside]


def shapes(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Per text: length, word length, share of different words, of upper case, digits, marks, white space, line ends."""
    from blotter.llm.textbytes import SPACE, mix, range_hash, running, words
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    who = np.repeat(np.arange(n), np.diff(offsets))
    share = lambda hit: np.bincount(who[hit], minlength=n) / size
    start, end, text = words(data, offsets)
    count = np.bincount(text, minlength=n)
    # a word's hash with its text's number mixed in; one of each pair
    _, first = np.unique(mix(range_hash(running(data), start, end) + text.astype(np.uint64)), return_index=True)
    different = np.bincount(text[first], minlength=n)
    mark = ((data > 0x20) & (data < 0x30)) | ((data > 0x39) & (data < 0x41)) | ((data > 0x5A) & (data < 0x61)) | ((data > 0x7A) & (data < 0x7F))
    return np.stack((np.log1p(np.diff(offsets)), size / np.maximum(count, 1), different / np.maximum(count, 1),
                     share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57)), share(mark),
                     share(SPACE[data]), share(data == 10)), axis=1)


def vectors(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per text its features, their values (GAIN times the share), and the shape measures of all."""
    idx, val, shape = [], [], []
    for t in texts:
        offsets, data = np.array([0, len(t)]), np.frombuffer(t, dtype=np.uint8)
        code, _ = gram_counts(offsets, data)
        feature, count = np.unique(code, return_counts=True)
        idx.append(feature)
        val.append(GAIN * count / max(1, len(code)))
        shape.append(shapes(offsets, data))
    return idx, val, np.concatenate(shape) if shape else np.zeros((0, SHAPES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def slopes(w: np.ndarray, v: np.ndarray, steps: np.ndarray, grams: tuple, z: np.ndarray, grades: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The loss (mean negative log likelihood and ridge) and its gradients by the shared weights of hashed grams ``w`` and
    shapes ``v`` and by the thresholds: the first, and the logs of the steps between them."""
    row, col, value = grams
    n, top = len(grades), len(steps)
    score = np.bincount(row, w[col] * value, minlength=n) + z @ v
    cuts = np.cumsum(np.concatenate((steps[:1], np.exp(steps[1:]))))
    tail = np.concatenate((np.ones((n, 1)), _sigmoid(score[:, None] - cuts), np.zeros((n, 1))), axis=1)
    p = np.maximum(tail[np.arange(n), grades] - tail[np.arange(n), grades + 1], 1e-9)
    slope = tail * (1 - tail)
    up, down = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
    g_score = -(up - down) / p                         # of the loss, by the score
    g_cut = np.zeros((n, top + 2))
    g_cut[np.arange(n), grades] += up / p
    g_cut[np.arange(n), grades + 1] -= down / p
    g_cuts = g_cut[:, 1:-1].sum(axis=0)
    g_steps = np.cumsum(g_cuts[::-1])[::-1].copy()
    g_steps[1:] *= np.exp(steps[1:])
    loss = -np.log(p).mean() + RIDGE * (w @ w + v @ v) / 2
    return loss, [np.bincount(col, g_score[row] * value, minlength=len(w)) / n + RIDGE * w, z.T @ g_score / n + RIDGE * v, g_steps / n]


def fit(texts: list[bytes], grades: np.ndarray) -> Model:
    """Cumulative-link regression by gradient descent with per-weight rates."""
    seen = np.unique(grades)
    if len(seen) < 2:
        return Model(np.zeros((1 << BITS) + SHAPES), np.zeros(SHAPES), np.ones(SHAPES), np.zeros(0), float(seen[0]) if len(seen) else 1.0)
    top = int(grades.max())
    idx, val, shape = vectors(texts)
    mean, scale = shape.mean(axis=0), shape.std(axis=0) + 1e-6
    z = np.clip((shape - mean) / scale, -5, 5)
    row = np.repeat(np.arange(len(texts)), [len(i) for i in idx])
    col, value = np.concatenate(idx), np.concatenate(val)
    w, v = np.zeros(1 << BITS), np.zeros(SHAPES)
    steps = np.concatenate(([0.0], np.zeros(top - 1)))  # first threshold, then logs of the steps between thresholds
    got = [np.full_like(x, 1e-6) for x in (w, v, steps)]
    for _ in range(STEPS):
        _, grads = slopes(w, v, steps, (row, col, value), z, grades)
        for x, g, s in zip((w, v, steps), grads, got):
            s += g * g
            x -= RATE * g / np.sqrt(s)
    cuts = np.cumsum(np.concatenate((steps[:1], np.exp(steps[1:]))))
    return Model(np.concatenate((w, v)), mean, scale, cuts, 0.0)


def tails(model: Model, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """P(grade > k) per text and k."""
    from blotter.llm.textbytes import spans
    n = len(offsets) - 1
    out = np.zeros((n, len(model.thresholds)))
    weights, v = model.weights[:1 << BITS], model.weights[1 << BITS:]
    for i, j in spans(offsets, CHUNK):
        at, part = offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]]
        code, who = gram_counts(at, part)
        total = np.maximum(np.bincount(who, minlength=j - i), 1)
        score = GAIN * np.bincount(who, weights[code], minlength=j - i) / total
        score = score + np.clip((shapes(at, part) - model.mean) / model.scale, -5, 5) @ v
        out[i:j] = _sigmoid(score[:, None] - model.thresholds)
    return out


def rated_sample(docs: DataFrame, ratings: DataFrame, most: int = SAMPLE) -> tuple[list[bytes], np.ndarray]:
    """The texts of the first ``most`` rated ids by hash. ``ratings``: doc_id, grade."""
    chosen = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(most)  # bounded by ``most``
    rows = docs.select("doc_id", text_of(docs).alias("text")).filter(F.octet_length("text") <= LONGEST)
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", F.col("grade").cast("int").alias("grade")) \
        .agg(F.min("text").alias("text"))                                                  # one text an id: ``most`` at most
    got = sorted(got.select("doc_id", "text", "grade").collect())
    return [r.text.encode() for r in got], np.array([r.grade for r in got], dtype=np.int64)


def graded(docs: DataFrame, ratings: DataFrame, keep: float = KEEP) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names) with expected_grade, tail (P(grade >= 1)) and keep."""
    model = fit(*rated_sample(docs, ratings))
    own = boxed(docs)
    schema = T.StructType([own.schema["row"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from blotter.llm.textbytes import text_bytes
        for batch in batches:
            offsets, data = text_bytes(batch.column("row").field("text"))
            if len(model.thresholds):
                t = tails(model, offsets, data)
                grade, tail = t.sum(axis=1), t[:, 0]
            else:
                grade = np.full(batch.num_rows, model.only)
                tail = np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(grade), pa.array(tail)], schema.names)

    return own.mapInArrow(score, schema).withColumn("keep", F.col("tail") >= keep)


def ratings_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for quality 0, else 1 if toxic, 2 if not."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))
