"""MinHash fingerprints of documents, their likeness, and near-duplicate classes.

A text's words (runs of anything but ASCII white space) give shingles of five
words; a text with fewer words is one shingle, a text without words has none.
Each shingle is a 64-bit hash x, and each of the permutations is the universal
hash (a * x + b) mod 2**64 with an odd a of its own; the signature is the
least value of each permutation over the shingles, computed in numpy over many
texts at once.  The fingerprint is the signature as hex, BITS_KEPT bits of each
value; the likeness of two fingerprints is the share of equal values, less
what chance makes equal, an estimate of the Jaccard similarity of the shingle
sets (the b-bit estimator).

:func:`near_duplicate_classes` cuts signatures into bands, groups equal bands
in Spark, and verifies the Jaccard similarity of the shingle sets.  There is no
table of the texts: bands and sizes are carried out of the pass that makes the signatures,
and only the texts of candidates are fetched again, each to the centres that it is compared with.

:func:`edited_table` compares each document with an edited version of itself
and with the next document.  The documents are sorted over the cluster by id
in one exchange; within a partition the next document is the next row, and the
pairs that cross partitions (one per partition) are joined afterwards.

Defined cases: a null text is an empty text; two texts without words are alike
(1.0), and unlike any other; repeated rows follow one another in the order of
their texts; the document after the last is the first (so a single one follows
itself); null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import lookup, written

PERMUTATIONS, SHINGLE, SEED = 128, 5, 11
BITS_KEPT = 8
BANDS, ROWS = 21, 6            # of 126 values: a pair of similarity 0.8 shares a band with probability 0.998
SIMILARITY = 0.8
CHUNK = 1 << 18                # bytes hashed at a time
STAR = 500                     # texts that one task compares with the same centre
ROLES = 200_000                # candidates (32 bytes each) that are broadcast to the scan of the texts, at most
BLOCK = 30_000                 # shingles on either side of a block of members that are compared
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@cache
def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_hashes(offsets: np.ndarray, data: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the word shingles of concatenated texts, in text order."""
    from blotter.llm.textbytes import shingles, word_hashes, words
    start, end, text = words(data, offsets)
    return shingles(word_hashes(data, start, end), text, len(offsets) - 1, size)


def signatures(texts: list[bytes], n: int = PERMUTATIONS, size: int = SHINGLE, different: np.ndarray | None = None) -> np.ndarray:
    """One row of ``n`` least values (upper 32 bits) per text; ``different`` is filled with the number of different shingles."""
    from blotter.llm.textbytes import spans
    a, b = permutations(n)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    out = np.full((len(texts), n), NONE, dtype=np.uint64)
    for i, j in spans(offsets, CHUNK):
        data = np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8)
        h, who = shingle_hashes(offsets[i:j + 1] - offsets[i], data, size)
        if not len(h):
            continue
        first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        rows = who[first] + i
        if different is not None:
            order = np.lexsort((h, who))
            x, y = h[order], who[order]
            new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            different[i:j] = np.bincount(y[new], minlength=j - i)
        for p in range(n):
            out[rows, p] = np.minimum.reduceat(h * a[p] + b[p], first)
    return (out >> np.uint64(32)).astype(np.uint32)


def fingerprint(signature: np.ndarray) -> str:
    """The low bits of each value, as hex."""
    return _kept_bits(signature).hex()


def _kept_bits(signature: np.ndarray) -> bytes:
    return (signature & np.uint32((1 << BITS_KEPT) - 1)).astype(f"<u{BITS_KEPT // 8}").tobytes()


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(text, band): the hash of each band of the signatures."""
    from blotter.llm.textbytes import mix
    sig = signature.astype(np.uint64)
    keys = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            h = mix(h * np.uint64(0x100000001B3) + sig[:, b * ROWS + r])
        keys[:, b] = h
    return keys


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows; 1 for equal fingerprints."""
    chance = 1 / (1 << BITS_KEPT)
    return np.clip((((x ^ y) & np.uint32((1 << BITS_KEPT) - 1)) == 0).mean(axis=1) - chance, 0, None) / (1 - chance)


# The results as they are stored: fingerprints and bands as bytes, half as long as hex.
RESULT = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, bands binary, size long"
NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands", "size"]


def compare(texts: list[str], following: list[str]) -> dict[str, list]:
    """The result columns for texts and the ones that follow them."""
    edited = []
    for t, nxt in zip(texts, following):
        cut = len(t) // 4
        edited.append((t[:len(t) - cut] + nxt[:cut]).encode())
    alone = following[-1:] if texts else []
    size = np.zeros(len(texts) + len(alone), dtype=np.int64)
    own = signatures([t.encode() for t in [*texts, *alone]], different=size)
    # following is texts shifted by one, unless the caller pairs texts that don't follow one another
    if following[:-1] == texts[1:]:
        nexts, own = own[1:], own[:-1]
    else:
        nexts, own = signatures([t.encode() for t in following]), own[:len(texts)]
    after = signatures(edited)
    return {"n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(e).digest() for e in edited],
            "fingerprint": [_kept_bits(s) for s in own], "edited_fingerprint": [_kept_bits(s) for s in after],
            "near_edited": likeness(own, after).tolist(), "near_next": likeness(own, nexts).tolist(),
            "bands": [k.astype("<i8").tobytes() for k in band_keys(own).view(np.int64)], "size": size[:len(texts)].tolist()}


def _sorted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a partition sorted by id: results of all rows but the last; the first and last rows as they are."""
    held: tuple | None = None
    none = {name: None for name in NAMES}

    def edge(kind: str, doc_id, text: str) -> dict:
        return {"doc_id": doc_id, "edge": kind, "text": text} | none

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = []
        for i in range(0, len(ids), 256):
            part_ids, part = ids[i:i + 256], texts[i:i + 256]
            if held is None:
                out.append(edge("first", part_ids[0], part[0]))
            else:
                part_ids, part = [held[0], *part_ids], [held[1], *part]
            if len(part) > 1:
                found = compare(part[:-1], part[1:])
                out += [dict(zip(("doc_id", "edge", "text", *found), row)) for row in
                        zip(part_ids, [None] * len(part), [None] * len(part), *found.values())]
            held = (part_ids[-1], part[-1])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_schema(batch.schema.field(0).type))
            id_type = batch.schema.field(0).type
    if held is not None:
        yield pa.RecordBatch.from_pylist([edge("last", *held)], schema=_schema(id_type))


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_type), ("edge", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()),
                      ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
                      ("near_edited", pa.float64()), ("near_next", pa.float64()), ("bands", pa.binary()), ("size", pa.int64())])


def _one_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = compare_each(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in found.values())], ["doc_id", *found])


def compare_each(texts: list[str], following: list[str]) -> dict[str, list]:
    rows = [compare([t], [f]) for t, f in zip(texts, following)]
    return {k: [r[k][0] for r in rows] for k in rows[0]} if rows else compare([], [])


def edited_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", classes: bool = False) -> DataFrame:
    """Per document its fingerprint, the edited text's, and their likeness; with ``classes`` also its near-duplicate class_id."""
    found = _edited(docs, id_column, text_column).select("doc_id.*", *NAMES)
    if classes:
        found = _with_class(found, text_classes(found.select("doc_id", "text_key", "bands", "size"), _keyed(docs, id_column, text_column)))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next",
                        *(["class_id"] if classes else []))


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with class_id: that of the text's class, or the row's own id for a text that is alone."""
    if classes.count() <= ROLES:
        found = rows.join(F.broadcast(classes), "text_key", "left")
    else:
        found = lookup(rows, classes, ["text_key"])
    alone = F.col("class_of").isNull()
    return found.withColumn("class_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_of.id"))).drop("class_of")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text, text_key)"""
    given = docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    return given.withColumn("text_key", F.xxhash64("text"))


def _edited(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """:func:`edited_table` with the struct (doc_id, text_key) as its doc_id."""
    spark = docs.sparkSession
    given = _keyed(docs, id_column, text_column).select(F.struct("doc_id", "text_key").alias("doc_id"), "text")
    id_type = given.schema["doc_id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id.doc_id").asc_nulls_first()
    runs = given.repartitionByRange(n, order).sortWithinPartitions(order, "text")
    found = written(runs.withColumn("part", F.spark_partition_id()).mapInArrow(
        _sorted_pairs_of, f"doc_id {id_type}, part int, edge string, text string, {RESULT}"), "minhash-runs")
    main = found.filter("edge is null").drop("edge", "text", "part")
    # Two small numbers for each partition say which partition follows which.
    parts = sorted(r[0] for r in found.filter("edge = 'first'").select("part").collect())
    if not parts:
        return main
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, next_part int")
    last = found.filter("edge = 'last'").select("part", "doc_id", "text")
    first = found.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    pairs = last.join(follows, "part").join(first, "next_part").select("doc_id", "text", "next_text")
    return main.unionByName(written(pairs.mapInArrow(_one_pair, f"doc_id {id_type}, {RESULT}"), "minhash-edges"))


def _sorted_pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`_sorted_pairs` with the partition's number beside each row."""
    part: list = []

    def plain() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part[:] = [batch.column(2)[0].as_py()]
                yield batch.select([0, 1])

    for out in _sorted_pairs(plain()):
        column = pa.array(np.full(out.num_rows, part[0], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([out.column(0), column, *out.columns[1:]], ["doc_id", "part", *out.schema.names[1:]])


# --- near-duplicate classes --------------------------------------------------
def _signed(given: DataFrame) -> DataFrame:
    """(doc_id, text_key, bands, size) of (doc_id, text, text_key)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                size = np.zeros(part.num_rows, dtype=np.int64)
                keys = band_keys(signatures([t.encode() for t in part.column(2).to_pylist()], different=size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([k.astype("<i8").tobytes() for k in keys], pa.binary()),
                                                  pa.array(size)], ["doc_id", "text_key", "bands", "size"])

    id_type = given.schema["doc_id"].dataType.simpleString()
    return given.select("doc_id", "text_key", "text").mapInArrow(lambda b: make(x.select(["doc_id", "text_key", "text"]) for x in b),
                                                                 f"doc_id {id_type}, text_key long, bands binary, size long")


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, size, bands) -> (text_key, size, key), one row for each band."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<i8")
        rows = np.repeat(np.arange(batch.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(keys)],
                                         ["text_key", "size", "key"])


def _shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(np.array([0, len(text)]), np.frombuffer(text, dtype=np.uint8))[0])


def _verified(pairs: DataFrame, nodes: DataFrame, given: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of text keys, a written table, whose shingle sets are as similar as that.

    ``u`` is a centre.  Each text goes from the scan to the centres that it is compared with, those of a centre in
    slices of about STAR texts, the centre's own text to each slice; a slice is streamed past its centre's set.
    """
    stars = written(pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("slices")), "minhash-centres")
    at = F.pmod(F.xxhash64("v"), F.col("slices")).alias("slice")
    others = lookup(pairs, stars, ["u"]).select(F.col("v").alias("text_key"), "u", at, F.lit(1).alias("place"))
    centres = stars.select(F.col("u").alias("text_key"), "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("place"))
    roles = others.unionByName(centres).join(nodes.select("text_key", "rep"), "text_key")
    texts = _texts_of(written(roles, "minhash-roles"), given).select("u", "slice", "place", F.col("text_key").alias("v"), "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, mine = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            u, v = [], []
            for centre, part, place, other, text in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 0:
                    if star != (centre, part):
                        star, mine = (centre, part), _shingle_set(text.encode())
                    continue
                own = _shingle_set(text.encode())
                both = len(np.intersect1d(mine, own, assume_unique=True))
                if both >= similarity * (len(mine) + len(own) - both) and both > 0:
                    u.append(centre)
                    v.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    n = int(given.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(n, "u", "slice").sortWithinPartitions("u", "slice", "place", "v").mapInArrow(verify, "u long, v long")


def _texts_of(roles: DataFrame, given: DataFrame) -> DataFrame:
    """``roles`` (text_key, rep and others; a written table) with the text, from another scan."""
    if roles.count() <= ROLES:
        roles = F.broadcast(roles)
    return given.join(roles, (given["text_key"] == roles["text_key"]) & given["doc_id"].eqNullSafe(roles["rep"])).drop(given["text_key"], given["doc_id"])


def _across(shared: DataFrame, roots: DataFrame, nodes: DataFrame, given: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the links between different classes of one band.

    Members outside of the band's main class meet all members, in blocks of about BLOCK shingles on either side: a task
    has two slices of shingle sets, counts their intersections from the shingles they share, and gives back links only.
    """
    named = lookup(shared, roots.select(F.col("node").alias("text_key"), "root"), ["text_key"]) \
        .select("key", "text_key", "size", F.coalesce("root", "text_key").alias("class"))
    named = written(named, "minhash-named")
    per = named.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    per = per.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"),
                                 F.sum("size").alias("all_size"), F.max_by("size", F.struct("n", "class")).alias("main_size"))
    cuts = lambda c: F.ceil(c / BLOCK)
    mixed = per.filter("most < n").select("key", "main", cuts(F.col("all_size") - F.col("main_size")).alias("few_cuts"), cuts(F.col("all_size")).alias("cuts"))
    named = lookup(named, written(mixed, "minhash-mixed"), ["key"]).filter("main is not null")
    named = written(named, "minhash-members")
    roles = written(named.select("text_key").distinct().join(nodes.select("text_key", "rep"), "text_key"), "minhash-members-ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_shingle_set(t.encode()).tobytes() for t in batch.column(1).to_pylist()], pa.binary())],
                                             ["text_key", "shingles"])

    found = _texts_of(roles, given).select("text_key", "text").mapInArrow(sets, "text_key long, shingles binary")
    found = written(found.groupBy("text_key").agg(F.first("shingles").alias("shingles")), "minhash-sets")
    at = lambda n: F.pmod(F.xxhash64("text_key"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = ["key", "class", "text_key", "side", "i", "j"]
    few = named.filter("class <> main").withColumn("side", F.lit(0)).withColumn("i", at(F.col("few_cuts"))).withColumn("j", every(F.col("cuts")))
    all_ = named.withColumn("side", F.lit(1)).withColumn("j", at(F.col("cuts"))).withColumn("i", every(F.col("few_cuts")))
    placed = written(few.select(*columns).unionByName(all_.select(*columns)), "minhash-blocks")

    def links(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy()
        parts = [block.filter(pa.array(side == k)) for k in (0, 1)]
        u, v = _block_links(*([p.column(c).to_pylist() for c in ("text_key", "class", "shingles")] for p in parts), similarity)
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return lookup(placed, found, ["text_key"]).groupBy("key", "i", "j").applyInArrow(links, "u long, v long").distinct()


def _block_links(few: list[list], all_: list[list], similarity: float) -> tuple[list[int], list[int]]:
    """The pairs of ``few`` and ``all_`` (keys, classes, shingle sets) of different classes that are as similar as that."""
    a, b = ([np.frombuffer(x, dtype=np.uint64) for x in rows[2]] for rows in (few, all_))
    if not a or not b:
        return [], []
    size_a, size_b = (np.array([len(x) for x in xs]) for xs in (a, b))
    x, y = np.concatenate(a), np.concatenate(b)
    who_a, who_b = np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b)
    order = np.argsort(y, kind="stable")
    y, who_b = y[order], who_b[order]
    low, high = np.searchsorted(y, x, side="left"), np.searchsorted(y, x, side="right")
    both = np.zeros(len(a) * len(b), dtype=np.int64)
    times = high - low
    upto = np.concatenate(([0], np.cumsum(times)))
    i = 0
    while i < len(x):                                   # a few million meetings of equal shingles at a time
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + (1 << 22), side="right")) - 1)
        n = times[i:j]
        at = np.repeat(low[i:j] - (upto[i:j] - upto[i]), n) + np.arange(upto[j] - upto[i])
        both += np.bincount(np.repeat(who_a[i:j], n) * len(b) + who_b[at], minlength=len(both))
        i = j
    both = both.reshape(len(a), len(b))
    alike = (both > 0) & (both >= similarity * (size_a[:, None] + size_b[None, :] - both))
    alike &= np.array(few[1])[:, None] != np.array(all_[1])[None, :]
    u, v = np.nonzero(alike)
    return [few[0][k] for k in u], [all_[0][k] for k in v]


def near_duplicate_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                           similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id): the smallest id reachable over texts of at least this Jaccard similarity.

    Equal texts are one node.  Nodes that share a band are candidates, in two steps that miss none of them: first
    every node is verified against one centre, the best known member of its bands, which makes one class of what
    belongs together in all but rare cases; then the members of a band outside of its main class are
    compared with all members, inside blocks that give back links only.  So a band of thousands of near copies costs no
    more pairs than it has members; a pair inside one class could not change the classes.
    """
    given = _keyed(docs, id_column, text_column)
    rows = written(_signed(given), "minhash-signed")
    return _with_class(rows.select("doc_id", "text_key"), text_classes(rows, given, similarity)).select("doc_id", "class_id")


def text_classes(rows: DataFrame, given: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(text_key, class_of): the struct holds the class's smallest id; only texts that are not alone.

    ``rows``: doc_id, text_key, bands, size of each document; ``given``: doc_id, text, text_key, read again for candidates."""
    from blotter.llm.components import components
    nodes = written(rows.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"),
                                                 F.first("bands").alias("bands")), "minhash-nodes")
    bands = nodes.filter("size > 0").select("text_key", "size", "bands").mapInArrow(_band_rows, "text_key long, size long, key long")
    held = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")     # a band of one has no pair
    shared = written(bands.join(held, "key"), "minhash-shared")
    # A band's centre is its member that shares most bands with others: of a text and its edited copies, the text.
    fame = shared.groupBy("text_key").agg(F.sum("n").alias("fame"))
    shared = written(shared.join(fame, "text_key"), "minhash-fame")
    centre = shared.groupBy("key").agg(F.max_by(F.struct("text_key", "size"), F.struct("fame", "text_key")).alias("centre"))
    fits = F.least("size", "centre.size") >= similarity * F.greatest("size", "centre.size")
    near = lookup(shared, centre, ["key"]).filter((F.col("text_key") != F.col("centre.text_key")) & fits) \
        .groupBy(F.col("text_key").alias("v"), F.col("centre.text_key").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    stars = written(near.groupBy("v").agg(F.max_by("u", F.struct("n", "u")).alias("u")).select("u", "v"), "minhash-pairs")
    first = written(_verified(stars, nodes, given, similarity), "minhash-stars")
    roots = written(components(first), "minhash-roots")
    more = written(_across(shared, roots, nodes, given, similarity), "minhash-more")
    if not more.isEmpty():
        roots = written(components(first.unionByName(more)), "minhash-classes")
    named = nodes.join(roots, nodes["text_key"] == roots["node"], "left").filter("root is not null or copies > 1") \
        .select("text_key", "rep", F.coalesce("root", "text_key").alias("root"))
    classes = named.groupBy("root").agg(F.struct(F.min("rep").alias("id")).alias("class_of"))
    return written(named.join(classes, "root").select("text_key", "class_of"), "minhash-members")
