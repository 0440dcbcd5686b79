"""Mixture-controlled packing of tokenised documents by deficit round-robin over source queues.

Each source is a queue of documents, cut every quantum (its target share of a
window).  In every round a queue sends its next quantum, so each round's pieces
make one window: the piece that ends at token ``e`` of its queue is sent in
round ``e / quantum``.  The rounds of all pieces come from running sums alone,
so deficits are carried across windows and partitions without any task seeing
a whole queue.  In the order (round, source, place in the queue) the pieces
form one stream, which is cut every ``window`` tokens.  A quantum of under
LEAST tokens is sent as several at once, every few rounds.  In every window a
source's tokens differ from its share by a few tokens, or by LEAST.

The stream's rest is cut at descending powers of two, so nothing is padded.

Running sums are two-level: queues are cut into hash ranges of about CHUNK
documents, rounds into groups; the sums of the parts are few.

Defined cases: a null text is empty; every document ends with the id END, so
an empty one is one token; null is a source like any other; repeated rows are
packed once each; an empty table gives an empty result; null ids are allowed.  A share
of 0 (or less) counts as :data:`NO_SHARE`: that source's documents are packed too, in
pieces far apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import text_of, unit, written

WINDOW, END = 2048, 1
CHUNK = 4096     # documents of a queue summed in one task
GROUP = 512      # rounds ordered in one task
FAN = 4096       # groups summed in one task
LEAST = 16       # tokens that a queue sends at once, at least
NO_SHARE = 1e-6  # what a share of 0 counts as: all documents are packed


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def tokenised(docs: DataFrame, path: str, end: int = END, id_column: str = "doc_id", text_column: str = "text",
              source_column: str = "source") -> DataFrame:
    """(row, doc_id, source, tokens, ids): ids as little-endian 32-bit numbers in 16 bits each where the vocabulary allows."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from blotter.llm.bpe import encoder
        coder = encoder(path)
        kind = _kind(coder.vocabulary)
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                ids = [np.append(x, end).astype(kind) for x in coder.encode(part.column(2).to_pylist())]
                rows = np.arange(at, at + len(ids))
                at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([np.dtype(kind).itemsize] * len(ids), pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["row", "doc_id", "source", "tokens", "width", "ids"])

    given = docs.select(docs[id_column].alias("doc_id"), docs[source_column].cast("string").alias("source"), text_of(docs, text_column).alias("text"))
    id_type = dict(given.dtypes)["doc_id"]
    return given.mapInArrow(make, f"row long, doc_id {id_type}, source string, tokens long, width int, ids binary")


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _starts(sums: DataFrame, key: str, value: str) -> DataFrame:
    """(key, start): the sum of all smaller keys' values, in two levels."""
    sums = sums.withColumn("block", F.expr(f"{key} div {FAN}"))
    blocks = sums.groupBy("block").agg(F.sum(value).alias("block_sum"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("block_sum").over(before(Window.orderBy("block"))), F.lit(0)).alias("block_start"))
    within = F.coalesce(F.sum(value).over(before(Window.partitionBy("block").orderBy(key))), F.lit(0))
    return sums.withColumn("within", within).join(blocks, "block").select(key, (F.col("block_start") + F.col("within")).alias("start"))


def placed(rows: DataFrame, window: int = WINDOW, shares: dict[str | None, float] | None = None, seed: int = 3, least: int = LEAST) -> DataFrame:
    """(row, parts): where the parts of each document's tokens stand in the one stream, as structs (start, length, at).
    ``rows``: row, doc_id, source, tokens.

    ``shares``: target share of the tokens by source (default: what each source has, so that all queues end together).
    """
    spark = rows.sparkSession
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    queue = lambda source: F.coalesce(F.concat(F.lit("="), source), F.lit(""))  # noqa: E731  null is a name of its own
    rows = rows.select("row", "tokens", queue(F.col("source")).alias("queue"), unit(F.lit(seed), "doc_id", "tokens").alias("u"))
    queues = rows.groupBy("queue").agg(F.sum("tokens").alias("queue_tokens"), F.count(F.lit(1)).alias("n"))
    if shares is None:
        share = F.col("queue_tokens") / F.lit(float(max(total, 1)))
    else:
        named = spark.createDataFrame([("" if k is None else f"={k}", float(v)) for k, v in shares.items()], "queue string, share double")
        queues = queues.join(named, "queue", "left")
        share = F.coalesce("share", F.col("queue_tokens") / F.lit(float(max(total, 1))))
    queues = queues.select("queue", (F.greatest(share, F.lit(NO_SHARE)) * window).alias("quantum"), F.ceil(F.col("n") / CHUNK).alias("chunks"))
    rows = rows.join(queues, "queue").withColumn("chunk", F.floor(F.col("u") * F.col("chunks")))
    # place in the queue: what the earlier chunks hold, and the earlier documents of the chunk
    chunks = rows.groupBy("queue", "chunk").agg(F.sum("tokens").alias("chunk_tokens"))
    chunks = chunks.select("queue", "chunk", F.coalesce(F.sum("chunk_tokens").over(before(Window.partitionBy("queue").orderBy("chunk"))), F.lit(0)).alias("chunk_start"))
    own = F.coalesce(F.sum("tokens").over(before(Window.partitionBy("queue", "chunk").orderBy("u", "row"))), F.lit(0))
    rows = rows.withColumn("own", own).join(chunks, ["queue", "chunk"]).withColumn("sent", F.col("chunk_start") + F.col("own"))
    # cut where the queue's numbered sendings end; those next to the first and last one absorb the rounding
    every = F.ceil(F.lit(float(least)) / F.col("quantum"))
    rows = rows.withColumn("every", F.when(F.col("quantum") < least, every).otherwise(F.lit(1)).cast("long"))
    rows = rows.withColumn("step", F.col("quantum") * F.col("every"))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.floor(F.col("sent") / F.col("step")), F.ceil((F.col("sent") + F.col("tokens")) / F.col("step")) + 1)))
    bound = lambda nth: F.floor(nth * F.col("step"))
    rows = rows.withColumn("from", F.greatest("sent", bound(F.col("nth") - 1))).withColumn("to", F.least(F.col("sent") + F.col("tokens"), bound(F.col("nth"))))
    rows = rows.filter(F.col("to") > F.col("from")).withColumn(
        "round", F.col("nth") * F.col("every") + F.pmod(F.xxhash64("queue"), F.col("every")))  # queues of one pace take turns
    rows = written(rows.select("row", (F.col("from") - F.col("sent")).alias("start"), (F.col("to") - F.col("from")).alias("length"), "queue", F.col("from").alias("sent"),
                               "round", F.expr(f"round div {GROUP}").alias("group")), "pack-rounds")
    groups = _starts(rows.groupBy("group").agg(F.sum("length").alias("group_tokens")), "group", "group_tokens")
    groups = groups.withColumnRenamed("start", "group_start")
    earlier = F.coalesce(F.sum("length").over(before(Window.partitionBy("group").orderBy("round", "queue", "sent", "row"))), F.lit(0))
    rows = rows.withColumn("earlier", earlier).join(groups, "group")
    return rows.groupBy("row").agg(F.collect_list(F.struct("start", "length", (F.col("group_start") + F.col("earlier")).alias("at"))).alias("parts"))


def tail_cuts(total: int, window: int) -> list[int]:
    """Where the sequences after the last full window end: descending powers of two."""
    at, out = total - total % window, []
    for bit in reversed(range(max(1, total % window).bit_length())):
        if (total % window) >> bit & 1:
            at += 1 << bit
            out.append(at)
    return out


def _stretches(parts: list[dict]) -> list[tuple[int, int, int]]:
    """(from, to, place of the document's first token) in the stream; parts that follow one another in it are one."""
    out: list[tuple[int, int, int]] = []
    for p in sorted(parts, key=lambda p: p["start"]):
        a, skip = p["at"], p["at"] - p["start"]
        if out and out[-1][1] == a and out[-1][2] == skip:
            out[-1] = (out[-1][0], a + p["length"], skip)
        else:
            out.append((a, a + p["length"], skip))
    return out


def pieces(rows: DataFrame, total: int, window: int = WINDOW) -> DataFrame:
    """One row per piece of (doc_id, tokens, width, ids, parts)."""
    full, tail = total // window, tail_cuts(total, window)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc", "start", "length", "crc", "tokens", "sequence", "offset")}
            for i, (n, width, ids, parts) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)))):
                ids = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                for a, end, skip in _stretches(parts):
                    while a < end:
                        sequence = a // window
                        first, last = sequence * window, (sequence + 1) * window
                        if sequence >= full:  # in the rest
                            k = next(k for k, x in enumerate(tail) if a < x)
                            first, last, sequence = tail[k - 1] if k else full * window, tail[k], full + k
                        b = min(last, end)
                        for k, v in (("doc", i), ("start", a - skip), ("length", b - a), ("crc", zlib.crc32(ids[a - skip:b - skip].tobytes())),
                                     ("tokens", n), ("sequence", sequence), ("offset", a - first)):
                            out[k].append(v)
                        a = b
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            docs = batch.column(0).take(pa.array(out.pop("doc"), pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, *(pa.array(v, pa.int64()) for v in out.values())], names)

    given = rows.select("doc_id", "tokens", "width", "ids", "parts")
    return given.mapInArrow(make, f"doc_id {dict(given.dtypes)['doc_id']}, start long, length long, ids_crc32 long, "
                                  "doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END,
         shares: dict[str | None, float] | None = None, least: int = LEAST) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens. ``least``: tokens that a source sends at once, at
    least; more give longer pieces, and windows that differ from the shares by as much."""
    coded = tokenised(docs, path or vocabulary_path(), end)
    coded = written(coded, "pack-ids")
    at = placed(coded.select("row", "doc_id", "source", "tokens"), window, shares, least=least)
    total = coded.agg(F.sum("tokens")).first()[0] or 0
    return pieces(coded.select("row", "doc_id", "tokens", "width", "ids").join(at, "row"), total, window)
