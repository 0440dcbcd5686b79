"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a 64-bit key (here a hash of the text, so that equal texts
lie together) and, among equal keys, by a second one.  Splitters cut that
order into shards of near equal bytes.  They are found as in histogram sort:
candidate boundaries (probes) are spread over the interval in which each
splitter must lie, the exact bytes below every probe are counted in one
aggregation over all partitions, and the intervals shrink until each
splitter's count is within tolerance of its goal.  Only then are rows moved,
once.  A key that holds more than the tolerance (a group of copies) is cut by
its second key; smaller groups stay whole.

Defined cases: a null text has size 1 and the crc32 of no bytes; repeated
rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import text_of, written

BITS = 12          # bits of the interval that one round of probes resolves
TOLERANCE = 0.005  # of a shard's goal
RUN = 20_000       # rows numbered in one task at a time, about


def keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[Column, Column]:
    """The order of the rows: hash of the text, then hash of the id."""
    return F.xxhash64(text_of(docs, text_column)), F.xxhash64(F.lit(1), docs[id_column])


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key, second, size, text_crc32): what the order and the shards need of a row."""
    text, (key, second) = text_of(docs, text_column), keys(docs, id_column, text_column)
    return docs.select(docs[id_column].alias("doc_id"), key.alias("key"), second.alias("second"),
                       (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))


def _probe(rows: DataFrame, column: str, width: int, inside: list[int]) -> dict[int, int]:
    """Exact bytes of each sub-interval of the intervals ``inside`` (of 2**width keys each).

    One pass of partial sums; at most 2**BITS results for each interval, of which there are fewer than shards.
    """
    if width < 64:
        rows = rows.filter(F.shiftright(column, width).isin(inside))
    step = max(0, width - BITS)
    return {r[0]: r[1] for r in rows.groupBy(F.shiftright(column, step).alias("slot")).agg(F.sum("size")).collect()}


def _refine(rows: DataFrame, column: str, goals: dict[int, float], start: int, slack: float) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """Boundaries on ``column`` whose exact bytes below are within ``slack`` of the goals.

    ``start``: bytes below all of ``rows``.  Returns the boundaries found, and for goals that fall within one
    single key the key and the bytes below it.
    """
    found: dict[int, int] = {}
    open_ = {j: (0, start) for j in goals}  # goal -> (its interval, bytes below that)
    width = 64
    while open_ and width > 0:
        sums = _probe(rows, column, width, sorted({x for x, _ in open_.values()}))
        step = max(0, width - BITS)
        after: dict[int, tuple[int, int]] = {}
        for j, (interval, below) in open_.items():
            best, inner = (float("inf"), 0), None
            for slot in sorted(s for s in sums if width == 64 or s >> (width - step) == interval):
                best = min(best, (abs(below - goals[j]), slot << step))
                if below + sums[slot] > goals[j]:
                    inner = inner or (slot, below)
                below += sums[slot]
                best = min(best, (abs(below - goals[j]), (slot + 1) << step))
                if below > goals[j]:
                    break
            if best[0] <= slack or inner is None:
                found[j] = best[1]
            else:
                after[j] = inner
        open_, width = after, step
    return found, open_


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int | None]]:
    """The ``shards - 1`` boundaries (key, second): a row is right of one if it is not below it."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    goals, slack = {j: total * j / shards for j in range(1, shards)}, tolerance * total / shards
    if not total:
        return []
    found, within = _refine(rows, "key", goals, 0, slack)
    cut: dict[int, tuple[int, int | None]] = {j: (b, None) for j, b in found.items()}
    for key in {k for k, _ in within.values()}:  # one key holds more than the tolerance
        own = {j: goals[j] for j, (k, _) in within.items() if k == key}
        below = next(b for k, b in within.values() if k == key)
        inner, same = _refine(rows.filter(F.col("key") == key), "second", own, below, slack)
        cut |= {j: (key, b) for j, b in inner.items()} | {j: (key, s) for j, (s, _) in same.items()}
    return [cut[j] for j in sorted(cut)]


def shard_of(key: Column, second: Column, at: list[tuple[int, int | None]]) -> Column:
    """How many splitters a row is not below."""
    top = (1 << 63) - 1
    shard = F.lit(0)
    for k, s in at:
        if k > top:
            continue
        right = key >= F.lit(k)
        if s is not None:
            right = (key > F.lit(k)) | ((key == F.lit(k)) & ((second >= F.lit(s)) if s <= top else F.lit(False)))
        shard = shard + right.cast("int")
    return shard


def slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0, in the order of key prefix and second key.

    A shard is far too much for one task: it is numbered in runs of about RUN rows, and the runs begin where the
    counts of the earlier ones end.
    """
    rows = rows.withColumn("bin", F.shiftright("key", 64 - BITS))
    bins = rows.groupBy("shard", "bin").agg(F.ceil(F.log2(F.greatest(F.count(F.lit(1)) / RUN, F.lit(1.0)))).cast("int").alias("q"))
    # at most 2**BITS bins and one more for each splitter
    rows = rows.join(F.broadcast(bins), ["shard", "bin"])
    rows = rows.withColumn("run", F.when(F.col("q") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftright(second, 64 - q)")))
    runs = rows.groupBy("shard", "bin", "run").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("bin", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "bin", "run", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "bin", "run").orderBy("second", "key", "doc_id"))
    rows = rows.withColumn("nth", nth)
    return rows.join(runs, ["shard", "bin", "run"]).withColumn("slot", F.col("start") + F.col("nth") - 1) \
               .drop("bin", "run", "q", "nth", "start")


def shard_table(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) under the law ``bytes``."""
    rows = written(digest(docs), "shard-digest")
    at = splitters(rows, shards, tolerance)
    rows = slots(rows.withColumn("shard", shard_of(F.col("key"), F.col("second"), at)))
    return rows.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, tolerance: float = TOLERANCE, files: int = 8) -> None:
    """Whole documents as one folder per shard: the splitters decide, then the rows move once.

    A column ``shard`` of ``docs`` itself is replaced.
    """
    at = splitters(written(digest(docs), "shard-digest"), shards, tolerance)
    key, second = keys(docs)
    rows = docs.withColumn("shard", shard_of(key, second, at))
    rows.repartition(shards * files, "shard", F.pmod(second, F.lit(files))).write.partitionBy("shard").parquet(path)
