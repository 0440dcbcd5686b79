"""Exact ranked lexical search: inner products of sparse term vectors, pruned by ball trees.

A document's vector has for each of its terms that a query holds the exact
integer ``w * x`` (``w`` the term's weight, ``x`` its saturated frequency), a
query's the number of times that it holds the term; the score is their inner
product.  Three passes for a block of queries:

1. texts to vectors (terms of the block only; other terms cannot score), written
   to the shared folder; the counts that weights need come from that table;
2. vectors are weighted and range-sorted by their strongest terms, so that
   documents with like vectors stand together, one large group over many tasks;
3. every task builds a ball tree over each of its Arrow batches (split between two
   far vectors at the median, so the depth is logarithmic) and searches it best
   first: a subtree whose ``q.centroid + far`` is below the query's k-th score so
   far holds no result, ``far`` being the smaller of ``|q| * radius`` and ``q.reach``
   (``reach``: the radius of each coordinate by itself, which is the tighter one
   for the few terms of a query).  The bound is widened by more than the rounding of
   its floating-point sums, leaves are scored in 64-bit integers, so the result is exact.  A task returns k rows a query, of which a window keeps
   the best k.

Queries are read in blocks of ``BLOCK_BYTES`` of text, one block on the driver at
a time; documents never come there.

Defined cases: a null or empty text has no terms and isn't counted; every row of
both tables counts, so repeated documents fill several ranks (a null id after all
others at equal scores) and repeated queries return their rows again; a query without
terms, and an empty table, give no rows; a single query text longer than a block is a block of its own.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import text_of, written

#: Ranks returned for a query.
BEST = 10
#: Bytes of query text in one block.
BLOCK_BYTES = 1 << 20
#: Documents in a leaf of a ball tree.
LEAF = 48
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 22
#: Relative widening of radii and bounds; sums of up to 10**6 doubles err by less than 10**-9 of their size.
SLACK = 1e-9

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """Occurrences of the terms; a long text is counted in pieces that end between terms."""
    text = text.translate(_FOLD)
    if len(text) <= PIECE:
        return Counter(text.split())
    out, at = Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        out.update(text[at:end].split())
        at = end
    return out


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for t in column.cast(pa.large_string()).cast(pa.large_binary()):
        yield t.as_py() or b""


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf): all terms are counted in ``n``, those of the vocabulary kept with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in parts:
            n, terms, tf = [], [], []
            for text in _bytes(part.column(1)):
                counts = term_counts(text)
                own = sorted((known[t], c) for t, c in counts.items() if t in known)
                n.append(counts.total())
                terms.append(np.array([t for t, _ in own], dtype=np.int32))
                tf.append(np.array([c for _, c in own], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), _lists(terms, pa.int32()), _lists(tf, pa.int64())],
                                             names=["doc_id", "n", "terms", "tf"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")) \
        .mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def weighted(vectors: DataFrame, weight: np.ndarray, n_docs: int, length: int) -> DataFrame:
    """(lead, doc_id, terms, value): value = weight times saturated frequency; lead: the strongest terms, for the order."""
    shared = vectors.sparkSession.sparkContext.broadcast(weight)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in parts:
            n = part.column(1).to_numpy()
            ends = part.column(2).offsets.to_numpy()
            terms, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
            ends = ends - ends[0]
            owner = np.repeat(np.arange(len(n)), np.diff(ends))
            m = 25 + (75 * n * n_docs) // length
            value = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
            leads = []
            for a, b in zip(ends[:-1], ends[1:]):
                top = np.lexsort((terms[a:b], -value[a:b]))[:4]
                leads.append(terms[a:b][top].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(leads, pa.list_(pa.int32())), part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms)),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value))],
                                             names=["lead", "doc_id", "terms", "value"])

    return vectors.filter(F.size("terms") > 0).mapInArrow(run, "lead array<int>, doc_id long, terms array<int>, value array<long>")


class BallTree:
    """A ball tree over sparse vectors: rows ``ends``, columns ``terms``, integer ``value``; ``width`` columns."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, value: np.ndarray, width: int, leaf: int = LEAF):
        self.width = width
        size = np.diff(ends)
        real = value.astype(np.float64)
        owner = np.repeat(np.arange(len(size)), size)
        norm = np.bincount(owner, real * real, minlength=len(size))
        order = np.arange(len(size))
        self.low, self.high, self.left, self.right, self.radius, centres, above_centre = [], [], [], [], [], [], []
        todo = [(0, len(size), -1, False)]
        while todo:
            lo, hi, above, is_left = todo.pop()
            node = len(self.low)
            if above >= 0:
                (self.left if is_left else self.right)[above] = node
            rows = order[lo:hi]
            at, first = _entries(ends, rows)
            c, v = terms[at], real[at]
            centre = np.bincount(c, v, minlength=width) / (hi - lo)
            most = np.zeros(width)
            np.maximum.at(most, c, v)
            own, square = norm[rows], float(centre @ centre)
            away = own - 2 * np.add.reduceat(v * centre[c], first) + square
            # Above the true squared distance by more than the sums can err.
            far = np.maximum(away, 0) + SLACK * (own + square)
            for held, x in ((self.low, lo), (self.high, hi), (self.left, -1), (self.right, -1), (self.radius, math.sqrt(far.max()) * (1 + SLACK)),
                            (centres, centre), (above_centre, most - centre)):
                held.append(x)
            if hi - lo > leaf:
                one = self._from(int(np.argmax(away)), rows, c, v, first, own)
                two = self._from(int(np.argmax(one)), rows, c, v, first, own)
                order[lo:hi] = rows[np.argsort(two - one, kind="stable")[::-1]]
                middle = (lo + hi) // 2
                todo += [(middle, hi, node, False), (lo, middle, node, True)]
        self.order, self.centres, self.reach = order, np.array(centres), np.array(above_centre)
        self.radius = np.array(self.radius)
        at, first = _entries(ends, order)
        self.terms, self.value = terms[at], value[at]
        self.ends = np.append(first, len(at))

    def _from(self, i: int, rows: np.ndarray, c: np.ndarray, v: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Squared distances of the node's rows from its row ``i``."""
        end = first[i + 1] if i + 1 < len(first) else len(c)
        dense = np.zeros(self.width)
        dense[c[first[i]:end]] = v[first[i]:end]
        return own - 2 * np.add.reduceat(v * dense[c], first) + own[i]

    def bounds(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each node a number that no inner product inside it exceeds."""
        counts = counts.astype(np.float64)
        dot = self.centres[:, terms] @ counts
        far = np.minimum(math.sqrt(float(counts @ counts)) * self.radius, self.reach[:, terms] @ counts)
        return (dot + far) * (1 + SLACK) + 1

    def search(self, terms: np.ndarray, counts: np.ndarray, dense: np.ndarray, ids: list, best: list, k: int) -> int:
        """Adds to ``best`` (a heap of at most k, worst first) what belongs there; the number of leaves visited."""
        bound = self.bounds(terms, counts)
        dense[terms] = counts
        heap, visited = [(-bound[0], 0)], 0
        while heap:
            limit, node = heapq.heappop(heap)
            if -limit < (best[0][0] if len(best) == k else 1):
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (max(limit, -bound[child]), child))
                continue
            visited += 1
            lo, hi = self.low[node], self.high[node]
            first = self.ends[lo:hi]
            a, b = first[0], self.ends[hi]
            score = np.add.reduceat(dense[self.terms[a:b]] * self.value[a:b], first - a)
            for j in np.flatnonzero(score >= (best[0][0] if len(best) == k else 1)).tolist():
                doc = ids[self.order[lo + j]]
                entry = (int(score[j]), doc is not None, -doc if doc is not None else 0)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        dense[terms] = 0
        return visited


def _entries(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the rows' entries one after another, where each row begins there)."""
    size = ends[rows + 1] - ends[rows]
    first = np.cumsum(size) - size
    return np.repeat(ends[rows] - first, size) + np.arange(int(size.sum())), first


def _searched(vectors: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], width: int, k: int, leaf: int) -> DataFrame:
    """(item, doc_id, score): each partition's k best documents of each query."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best: dict[int, list] = {item: [] for item, _, _ in asked}
        dense = np.zeros(width, dtype=np.int64)
        for part in parts:
            if not part.num_rows:
                continue
            ends = part.column(1).offsets.to_numpy().astype(np.int64)
            tree = BallTree(ends - ends[0], part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy(), width, leaf)
            ids = part.column(0).to_pylist()
            for item, terms, counts in asked:
                tree.search(terms, counts, dense, ids, best[item], k)
        rows = [(item, -doc if known else None, score) for item, found in best.items() for score, known, doc in found]
        if rows:
            item, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                             names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Lists of (item_id, text) of about ``block_bytes``; one list is on the driver at a time."""
    block, held = [], 0
    for row in items.select(items["item_id"].alias("item_id"), text_of(items).alias("text")).toLocalIterator():
        text = row.text.encode()
        if block and held + len(text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row.item_id, text))
        held += len(text)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each row of ``items``."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], "item long, rank int, doc_id long, score long").withColumn("item_id", F.lit(None).cast(kind))
    number = 0
    for block in _blocks(items, block_bytes):
        counts = [term_counts(text) for _, text in block]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        if not vocabulary:
            continue
        vectors = written(term_vectors(docs, vocabulary), "lexical-vectors")
        total = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total[0]:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for term, held in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's vocabulary
            df[term] = held
        queries = [(number + i, np.array([vocabulary[t] for t in c], dtype=np.int64), np.array(list(c.values()), dtype=np.int64))
                   for i, c in enumerate(counts) if c]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = [F.col("lead"), F.col("doc_id")]
        sorted_ = weighted(vectors, weights(total[0], df), total[0], total[1]).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = _searched(sorted_.select("doc_id", "terms", "value"), queries, len(vocabulary), k, leaf)
        first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = written(found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k), "lexical-best")
        names = spark.createDataFrame([(number + i, item) for i, (item, _) in enumerate(block)], "item long, item_id " + kind.simpleString())
        out = out.unionByName(best.join(F.broadcast(names), "item"))
        number += len(block)
    return out.select("item_id", "rank", "doc_id", "score")
