"""The exact top k of a column with any number of different values.

A plain group-by count shuffles one row per value and task.  Here every task keeps a
summary of at most ``capacity`` counters (Misra-Gries: when there are more, the next largest
counter is taken off all of them, and what was taken off at most bounds the error), whatever the number of values.
Summaries add up: over all tasks a value's true count lies between its summed
counter and that plus the summed errors ``E``.

With ``L`` the k-th largest summed counter, a value whose upper bound is below ``L`` is not
among the top k.  If ``E < L`` that holds for all values without a counter, so the others are
all candidates; a second pass counts them exactly, and the answer is proven.  If not (the values are too
alike for the capacity), all values are counted by a group-by, so the answer is exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.operators.trends import COUNT, top_k
from blotter.session import stored

#: Counters of one task.
CAPACITY = 100_000


def summaries(df: DataFrame, column: str, capacity: int = CAPACITY) -> DataFrame:
    """(value, counter, error): each task's counters, and its error bound in one row without a value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        error = 0
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            if len(held) > capacity:
                cut = sorted(held.values(), reverse=True)[capacity]
                held = {v: n - cut for v, n in held.items() if n > cut}
                error += cut
        values = list(held)
        for at in range(0, len(values), 10_000):
            part = values[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[v] for v in part], pa.int64()),
                                              pa.array([0] * len(part), pa.int64())], names=["value", "counter", "error"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([error], pa.int64())],
                                         names=["value", "counter", "error"])

    known = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"))
    return known.mapInArrow(run, "value string, counter long, error long")


def candidates(df: DataFrame, column: str, k: int, capacity: int = CAPACITY) -> DataFrame | None:
    """(value): all that can be among the top k, or None if the summaries cannot exclude the values that they dropped."""
    parts = stored(summaries(df, column, capacity), "summaries")
    error = parts.agg(F.coalesce(F.sum("error"), F.lit(0))).first()[0]
    sums = parts.filter("value is not null").groupBy("value").agg(F.sum("counter").alias("counter"))
    best = sums.orderBy(F.col("counter").desc()).limit(k).agg(F.min("counter"), F.count(F.lit(1))).first()
    if error and (best[1] < k or error >= best[0]):
        return None
    least = 0 if best[1] < k else best[0]
    return sums.filter(F.col("counter") + error >= least).select("value")


def top_values(df: DataFrame, column: str, k: int = 10, capacity: int = CAPACITY) -> DataFrame:
    """The k largest groups of ``column`` (not NULL) and their counts: count descending, then value."""
    known = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias(column))
    found = candidates(df, column, k, capacity)
    if found is not None:
        known = known.join(found, F.col(column) == F.col("value"), "left_semi")
    return top_k(known, column, k, COUNT)
