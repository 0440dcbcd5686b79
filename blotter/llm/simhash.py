"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: bit b is 1 if it is set in more than
half of the XXH64 values (seed 42) of its word shingles.  Two fingerprints
link at ``distance`` (3) or fewer differing bits.  To find the links without
comparing all pairs, a fingerprint is cut into three segments, each a word of
the Golay code of length 23 (perfect: every word has one nearest code word,
within 3 bits).  By pigeonhole three errors leave either

* a segment without error and another with at most one, or
* exactly one error in each segment.

Words that differ in one bit share a code word: the nearest one of the first
is within 4 bits of the second.  So each fingerprint gives several join keys:
on the left side the nearest code word of a fuzzy segment, on the right side
all code words within 4 bits (up to 6), next to the exact segment (33 or 34
bits) or to the other two fuzzy ones (36 bits).  Sides are joined on the keys
and each pair is verified by its differing bits.  The scheme loses no link.

Fingerprints are grouped before: equal ones are one node, so copies never
meet in pairs.  Components come from alternating stars over the links.

Defined cases: a null text is an empty one; a text without words has
fingerprint zero; fewer words than a shingle: the whole sequence is the
shingle; repeated rows are rows of their own; empty tables give empty
results; components take the smallest id that isn't null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import boxed, text_of, written
from blotter.llm.components import components

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: (lowest bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
ROWS = 20_000  # fingerprints keyed at a time


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    import xxhash
    found = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not found:
        return 0
    flat = b" ".join(found)
    gaps = np.flatnonzero(np.frombuffer(flat, dtype=np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(flat)]))
    k = min(shingle, len(found))
    counts, n = np.zeros(64, dtype=np.int64), len(found) - k + 1
    for i in range(0, n, 1 << 15):
        j = min(n, i + (1 << 15))
        cuts = map(slice, starts[i:j].tolist(), ends[i + k - 1:j + k - 1].tolist())
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(flat.__getitem__, cuts), repeat(SEED)), dtype=np.uint64, count=j - i)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): a hash of the text, and its fingerprint as a signed long."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from blotter.llm.textbytes import text_bytes
        for batch in batches:
            offsets, data = text_bytes(batch.column(2))
            at = offsets.tolist()
            fps = [fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
                                             ["doc_id", "text_key", "fp"])

    text = text_of(docs, text_column)
    given = docs.select(docs[id_column].alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return given.mapInArrow(make, f"doc_id {dict(given.dtypes)['doc_id']}, text_key long, fp long")


def join_keys(fps: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the join keys of fingerprints (uint64) on one side."""
    from blotter.llm import golay
    exact, fuzzy = [], []
    for low, bits in SEGMENTS:
        word = ((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        exact.append(word)
        fuzzy.append(golay.keys(word).astype(np.int64))
    keys, rows = [], []

    def add(case: int, parts: list[np.ndarray], good: np.ndarray) -> None:
        value = np.full(good.shape, case, dtype=np.int64)
        for p in parts:
            value = (value << np.int64(12 if p.ndim > 1 else 22)) | np.where(p < 0, 0, p).reshape(p.shape if p.ndim > 1 else (-1, 1))
        at = np.nonzero(good)
        keys.append(value[at])
        rows.append(at[0])

    every = slice(None) if right else slice(0, 1)
    for case, (i, j) in enumerate(permutations(range(3), 2)):
        near = fuzzy[j][:, every]
        add(case, [exact[i], near], near >= 0)
    # one error in each: the left side spreads over the third segment, the right side over the first two
    if right:
        a, b = fuzzy[0][:, :, None], fuzzy[1][:, None, :]
        shape = (len(fps), -1)
        a, b = np.broadcast_to(a, (len(fps), a.shape[1], b.shape[2])).reshape(shape), np.broadcast_to(b, (len(fps), a.shape[1], b.shape[2])).reshape(shape)
        c = np.broadcast_to(fuzzy[2][:, :1], a.shape)
    else:
        c = fuzzy[2]
        a, b = np.broadcast_to(fuzzy[0][:, :1], c.shape), np.broadcast_to(fuzzy[1][:, :1], c.shape)
    add(6, [a, b, c], (a >= 0) & (b >= 0) & (c >= 0))
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(distinct: DataFrame, right: bool) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), ROWS):
                part = fps[i:i + ROWS]
                key, row = join_keys(part.view(np.uint64), right)
                for k in range(0, len(key), 10 * ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(key[k:k + 10 * ROWS]), pa.array(part[row[k:k + 10 * ROWS]])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(make, "key long, fp long")


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v), u < v: fingerprints at ``distance`` (3 at most) or fewer differing bits; a pair may come more than once."""
    if distance > DISTANCE:
        raise ValueError("the keys promise links of up to 3 differing bits")
    left = _keyed(distinct, False).select("key", F.col("fp").alias("u"))
    right = _keyed(distinct, True).select("key", F.col("fp").alias("v"))
    near = (left["u"] < right["v"]) & (F.bit_count(left["u"].bitwiseXOR(right["v"])) <= distance)
    # a fingerprint has dozens of keys, but Spark sizes both sides by the fingerprints alone: never a broadcast
    return left.hint("merge").join(right.hint("merge"), (left["key"] == right["key"]) & near).select("u", "v")


def components_of(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) of a table of fingerprints: equal roots are linked, directly or through others."""
    distinct = written(fps.select("fp").distinct(), "simhash-distinct")
    roots = components(links(distinct, distance))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_key, fp, component_id): the smallest id that a document is linked to, directly or through others."""
    fps = written(fingerprints(docs, id_column, text_column, shingle), "simhash-fp")
    roots = written(components_of(fps, distance), "simhash-roots")
    ids = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(roots, "fp")
    least = ids.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = ids.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "text_key", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` of which no linked one has a smaller id (of equal ones one; null ids come last)."""
    fps = written(fingerprints(docs, "doc_id", "text", shingle), "simhash-fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    keep = fps.groupBy("fp").agg(first).join(components_of(fps, distance), "fp").groupBy("root").agg(F.min("first").alias("first"))
    keep = keep.select("first.doc_id", "first.text_key")
    rows = boxed(docs, of=F.xxhash64(text_of(docs)))
    rows = rows.join(keep, rows["row.doc_id"].eqNullSafe(keep["doc_id"]) & (rows["of"] == keep["text_key"]))
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("text_key"))
    return rows.withColumn("nth", nth).filter("nth = 1").select("row.*")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
