"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The field has two states, clean and toxic.  A word's evidence is the sum of
learnt weights of its hashed features (the word, its first letters, its last
letters); transitions between neighbouring words are learnt as well.  Training
tokens are labelled from the documents' labels: in a toxic training document
the words that occur in far more toxic than clean training documents are
toxic tokens, all others are clean ones.  The likelihood is maximised by
gradient steps on expected counts from forward-backward.

A document is one chain.  It is computed in runs of RUN words, many runs of many
documents at once: each run's steps are multiplied to one matrix, the matrices carry the
messages from run to run, and every run then starts from the messages of its neighbours.  (Training
takes the runs as chains of their own.)  Marginals of being toxic give the offending spans (maximal runs of
words at HALF or more) and, through a logistic link fitted on the training
documents, the document's score.

Defined cases: a null or empty text has no words and gets the score of no
evidence; documents without labels are scored like any other; without toxic
and clean labels every score is 0; repeated rows get equal scores; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import text_of

BITS = 18
RUN = 64
SAMPLE = 2500        # labelled documents of either class fitted on, the first by hash of their id
LONGEST = 60_000     # bytes; longer texts are not fitted on (they are scored)
EPOCHS, BATCH, RATE, RIDGE = 8, 4096, 0.25, 1e-6
HALF = 0.5
PREDICT = 0.7
CHUNK = 1 << 19
ODDS, LEAST = 4.0, 5  # a toxic word: this many times as frequent in toxic documents, in as many of them at least


@dataclass(frozen=True)
class Model:
    weights: np.ndarray   # three tables of 2**BITS
    bias: float
    trans: np.ndarray     # 2 x 2 log potentials
    link: np.ndarray      # of the document score
    mean: np.ndarray
    scale: np.ndarray


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of each word (n, 3), start, end, text): words are runs of letters, in lower case."""
    from blotter.llm.textbytes import range_hash, running, words
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    if len(low) > 1:  # capital letters of the Latin-1 block
        upper = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][upper] += 32
    start, end, text = words(low, offsets, ((low >= 97) & (low <= 122)) | (low >= 0x80))
    sums = running(low)
    head, tail = np.minimum(start + 6, end), np.maximum(end - 4, start)
    which = lambda a, b: (range_hash(sums, a, b) >> np.uint64(64 - BITS)).astype(np.int32)
    return np.stack((which(start, end), which(start, head), which(tail, end)), axis=1), start, end, text


def chains(text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each word stands: (chain, step); a chain is a run of RUN words of one text."""
    counts = np.bincount(text, minlength=n_texts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    per = -(-counts // RUN)
    return np.repeat(np.cumsum(per) - per, counts) + place // RUN, place % RUN


def carried(odds: np.ndarray, length: np.ndarray, trans: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The messages that enter each run of a longer chain from before and from after it, as shares of the toxic state.

    ``number``: 0, 1, 2 ... for the runs of a chain, which follow one another.
    """
    t = np.exp(trans)
    p = [np.ones(len(odds)), np.zeros(len(odds)), np.zeros(len(odds)), np.ones(len(odds))]     # row by row
    for s in range(odds.shape[1]):
        move = [[t[a, b] if s else np.where(number > 0, t[a, b], float(a == b)) for b in (0, 1)] for a in (0, 1)]
        q = [(p[2 * a] * move[0][b] + p[2 * a + 1] * move[1][b]) * (odds[:, s] if b else 1.0) for a in (0, 1) for b in (0, 1)]
        z, live = q[0] + q[1] + q[2] + q[3], s < length
        p = [np.where(live, x / z, y) for x, y in zip(q, p)]
    before, after = np.full(len(odds), 0.5), np.full(len(odds), 0.5)
    order = np.argsort(number, kind="stable")
    level = np.searchsorted(number[order], np.arange(int(number.max()) + 2 if len(number) else 1))
    rows = [order[a:b] for a, b in zip(level[:-1], level[1:])]
    for here in rows[1:]:
        x, k = before[here - 1], here - 1
        y0, y1 = (1 - x) * p[0][k] + x * p[2][k], (1 - x) * p[1][k] + x * p[3][k]
        before[here] = y1 / (y0 + y1)
    for here in rows[:0:-1]:
        x = after[here]
        y0, y1 = p[0][here] * (1 - x) + p[1][here] * x, p[2][here] * (1 - x) + p[3][here] * x
        after[here - 1] = y1 / (y0 + y1)
    return before, after


def forward_backward(odds: np.ndarray, length: np.ndarray, trans: np.ndarray, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state (chain, step), and expected transitions (2 x 2) inside of the rows.

    ``odds``: exp of the evidence. Messages are scaled to sum to one at every step. ``number``: where rows are runs of
    longer chains, their places there (see :func:`carried`).
    """
    n, steps = odds.shape
    t = np.exp(trans)
    before, after = (None, np.full(n, 0.5)) if number is None else carried(odds, length, trans, number)
    a1 = np.empty((steps, n))
    a1[0] = odds[:, 0] / (1 + odds[:, 0])
    if before is not None:
        y0 = (1 - before) * t[0, 0] + before * t[1, 0]
        y1 = ((1 - before) * t[0, 1] + before * t[1, 1]) * odds[:, 0]
        a1[0] = np.where(number > 0, y1 / (y0 + y1), a1[0])
    for s in range(1, steps):
        x1 = a1[s - 1]
        x0 = 1 - x1
        y0 = x0 * t[0, 0] + x1 * t[1, 0]
        y1 = (x0 * t[0, 1] + x1 * t[1, 1]) * odds[:, s]
        a1[s] = y1 / (y0 + y1)
    b1 = after
    marginal = np.empty((steps, n))
    pairs = np.zeros((2, 2))
    for s in range(steps - 1, -1, -1):
        m1 = a1[s] * b1
        m0 = (1 - a1[s]) * (1 - b1)
        marginal[s] = m1 / (m0 + m1)
        if s:
            live = s < length                        # beyond its end a chain's message stays as it is
            f0, f1 = (1 - b1), b1 * odds[:, s]
            x1 = a1[s - 1]
            x0 = 1 - x1
            p = [x0 * t[0, 0] * f0, x0 * t[0, 1] * f1, x1 * t[1, 0] * f0, x1 * t[1, 1] * f1]
            z = p[0] + p[1] + p[2] + p[3]
            pairs += np.array([[(v / z)[live].sum() for v in p[:2]], [(v / z)[live].sum() for v in p[2:]]])
            y0, y1 = t[0, 0] * f0 + t[0, 1] * f1, t[1, 0] * f0 + t[1, 1] * f1
            b1 = np.where(live, y1 / (y0 + y1), after)
    return marginal.T, pairs


def evidence(model_weights: np.ndarray, bias: float, features: np.ndarray) -> np.ndarray:
    return bias + model_weights[0][features[:, 0]] + model_weights[1][features[:, 1]] + model_weights[2][features[:, 2]]


def marginals(model: Model, features: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """P(toxic) of each word."""
    if not len(text):
        return np.zeros(0)
    chain, step = chains(text, n_texts)
    odds = np.ones((int(chain[-1]) + 1, RUN))
    odds[chain, step] = np.exp(np.clip(evidence(model.weights, model.bias, features), -25, 25))
    first = np.flatnonzero(step == 0)
    new = np.concatenate(([True], text[first][1:] != text[first][:-1]))
    number = np.arange(len(first)) - np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
    m, _ = forward_backward(odds, np.bincount(chain), model.trans, number)
    return m[chain, step]


def measures(m: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text: the log odds of its most toxic word, and of at least one; expected toxic words (log), and their share (log)."""
    worst = np.zeros(n_texts)
    np.maximum.at(worst, text, m)
    total = np.bincount(text, m, minlength=n_texts)
    count = np.bincount(text, minlength=n_texts)
    logit = lambda p: np.log((p + 1e-4) / (1 - p + 1e-4))
    return np.stack((logit(worst), np.log(total + 0.01), np.log((total + 0.01) / (count + 10)), np.log1p(count)), axis=1)


def token_labels(features: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for the words of toxic documents that toxic documents hold far more often than clean ones.

    The evidence of a whole word or of its first letters, by the number of documents.
    """
    out = np.zeros(len(text), dtype=bool)
    n1, n0 = toxic.sum(), (~toxic).sum()
    for k in (0, 1):
        key = np.unique(features[:, k].astype(np.int64) * len(toxic) + text)
        word, doc = key // len(toxic), key % len(toxic)
        c1 = np.bincount(word[toxic[doc]], minlength=1 << BITS)
        c0 = np.bincount(word[~toxic[doc]], minlength=1 << BITS)
        bad = (c1 >= LEAST) & ((c1 + 0.5) / (n1 + 1) > (1 + k) * ODDS * (c0 + 1.0) / (n0 + 1))
        out |= bad[features[:, k]]
    return out & toxic[text]


def fit(texts: list[bytes], toxic: np.ndarray, base_rate: float, seed: int = 1) -> Model | None:
    """The field and the link, from texts and their labels (a balanced sample; ``base_rate``: share of toxic labels)."""
    if not toxic.any() or toxic.all():
        return None
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    from blotter.llm.textbytes import spans
    parts = []
    for i, j in spans(offsets, CHUNK):
        f, _, _, who = tokens(offsets[i:j + 1] - offsets[i], np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8))
        parts.append((f, who + i))
    features, text = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    label = token_labels(features, text, toxic)
    chain, step = chains(text, len(texts))
    n = int(chain[-1]) + 1 if len(chain) else 0
    length = np.bincount(chain, minlength=n)
    first = np.cumsum(length) - length
    rng = np.random.default_rng(seed)
    weights, bias, trans = np.zeros((3, 1 << BITS)), np.full(1, -4.0), np.array([[0.0, -1.0], [0.0, 0.0]])
    grown = [np.full_like(x, 1e-3) for x in (weights, bias, trans)]
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            ids = np.sort(order[at:at + BATCH])
            token = np.concatenate([np.arange(first[c], first[c] + length[c]) for c in ids])
            row = np.repeat(np.arange(len(ids)), length[ids])
            f, y = features[token], label[token]
            odds = np.ones((len(ids), RUN))
            odds[row, step[token]] = np.exp(np.clip(evidence(weights, bias[0], f), -25, 25))
            m, pairs = forward_backward(odds, length[ids], trans)
            error = m[row, step[token]] - y
            same = row[1:] == row[:-1]
            seen = np.bincount(2 * y[:-1][same].astype(int) + y[1:][same], minlength=4).reshape(2, 2)
            g_w = np.stack([np.bincount(f[:, k], error, minlength=1 << BITS) for k in range(3)])
            g_w += RIDGE * len(token) * weights * (g_w != 0)
            for x, g, s in zip((weights, bias, trans), (g_w, error.sum(keepdims=True), pairs - seen), grown):
                s += g * g
                x -= RATE * g / np.sqrt(s)
    model = Model(weights.astype(np.float32), float(bias[0]), trans, np.zeros(5), np.zeros(4), np.ones(4))
    x = measures(marginals(model, features, text, len(texts)), text, len(texts))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate((np.ones((len(x), 1)), (x - mean) / scale), axis=1)
    # The sample is balanced by class; weights bring back the rate of the labels.
    share = toxic.mean()
    weight = np.where(toxic, base_rate / share, (1 - base_rate) / (1 - share))
    link = np.zeros(5)
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ link, -30, 30)))
        grad = z.T @ (weight * (p - toxic)) + 0.1 * link * (np.arange(5) > 0)
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-6, 0.1, 0.1, 0.1, 0.1])
        link = link - np.linalg.solve(hess, grad)
    return Model(model.weights, model.bias, trans, link, mean, scale)


def score_texts(model: Model | None, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """(score, toxic spans as byte offsets) of each text."""
    from blotter.llm.textbytes import spans
    n = len(offsets) - 1
    score, found = np.zeros(n), [[] for _ in range(n)]
    if model is None:
        return score, found
    for i, j in spans(offsets, CHUNK):
        features, start, end, text = tokens(offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]])
        m = marginals(model, features, text, j - i)
        z = (measures(m, text, j - i) - model.mean) / model.scale
        score[i:j] = 1 / (1 + np.exp(-np.clip(model.link[0] + z @ model.link[1:], -30, 30)))
        at = offsets[i:j] - offsets[i]
        last = -2
        for k in np.flatnonzero(m >= HALF).tolist():
            t = int(text[k])
            if k == last + 1 and text[last] == t:
                found[i + t][-1]["end"] = int(end[k] - at[t])
                found[i + t][-1]["weight"] = max(found[i + t][-1]["weight"], float(m[k]))
            else:
                found[i + t].append({"start": int(start[k] - at[t]), "end": int(end[k] - at[t]), "weight": float(m[k])})
            last = k
    return score, found


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[bytes], np.ndarray, float]:
    """Texts and labels of the first ``most`` documents of either class by hash of the id; the share of toxic labels."""
    rated = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r[0]): r[1] for r in rated.groupBy("toxic").count().filter("toxic in (0, 1)").collect()}
    order = (F.xxhash64(F.lit(9), "doc_id"), F.col("doc_id"))
    chosen = rated.filter("toxic = 1").orderBy(*order).limit(most).union(rated.filter("toxic = 0").orderBy(*order).limit(most))
    rows = docs.select("doc_id", text_of(docs).alias("text")).filter(F.octet_length("text") <= LONGEST)
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text an id
    got = sorted(got.select("doc_id", "text", "toxic").collect())                                               # 2 * most at most
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    got = list({r.text: r for r in got}.values())  # copies would count as so many witnesses
    return [r.text.encode() for r in got], np.array([r.toxic == 1 for r in got], dtype=bool), rate


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, predict: float = PREDICT) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans)."""
    model = fit(*labelled_sample(docs, labels.filter(~held_out(F.col("doc_id")))))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from blotter.llm.textbytes import text_bytes
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))
        for batch in batches:
            score, spans = score_texts(model, *text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    given = docs.select("doc_id", text_of(docs).alias("text"))
    out = given.mapInArrow(make, f"doc_id {dict(given.dtypes)['doc_id']}, score double, spans array<struct<start:long,end:long,weight:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= predict).cast("int").alias("predicted"), "spans")
