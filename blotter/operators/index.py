"""Exact category indexes for vocabularies of any size, without labels on the driver.

The index of a value is its rank by count (largest first; ties by value), for
several columns at once: one pass counts (column, value) with partial counts in
every task, the counts are range-sorted by column, count and value, every
partition numbers its rows, and the few partition sizes -- all that reaches the driver
-- give each partition its offset.  A rank within a column is then the rank over all
less the column's first one.

:meth:`ExactIndex.transform` joins the ranks back.  By construction the values that
can hold a large share of the rows have the smallest ranks, so the first ``HOT`` ranks of a column
are broadcast (at most ``HOT`` rows) and the rows with any other value, of which
none exceeds ``1 / HOT`` of the rows, are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.operators.ranks import dense_positions
from blotter.session import stored

#: Ranks of a column that are joined by broadcast.
HOT = 1000


class ExactIndex:
    """Ranks of the values of ``columns``: (input, value, count, index), a stored table."""

    def __init__(self, df: DataFrame, columns: list[str]):
        self.columns = list(columns)
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).cast("string").alias("value"))
                                              for c in columns])).alias("e")).select("e.*")
        counts = pairs.filter("value is not null").groupBy("input", "value").agg(F.count(F.lit(1)).alias("count"))
        ranked = dense_positions(counts, [F.col("input"), F.col("count").desc(), F.col("value")], "position")
        sizes = {r["input"]: r["n"] for r in ranked.groupBy("input").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.sizes = {c: sizes.get(c, 0) for c in columns}
        first, at = {}, 0
        for c in sorted(set(columns)):
            first[c], at = at, at + self.sizes[c]
        start = F.element_at(F.create_map(*[x for c in first for x in (F.lit(c), F.lit(first[c]).cast("long"))]), F.col("input"))
        self.table = stored(ranked.select("input", "value", "count", (F.col("position") - start).alias("index")), "index")

    def ranks(self, column: str) -> DataFrame:
        """(value, count, index) of one column."""
        return self.table.filter(F.col("input") == column).select("value", "count", "index")

    def transform(self, df: DataFrame, column: str, out: str, handle: str = "skip") -> DataFrame:
        """``df`` with the index of ``column`` as ``out`` (long).

        Rows whose value is NULL or has no rank: left out (``skip``), or given the
        next free index (``keep``).
        """
        if handle not in ("skip", "keep"):
            raise ValueError(f"handle must be skip or keep, not {handle}")
        ranks = self.ranks(column).select(F.col("value").alias("__value"), F.col("index").alias(out))
        same = F.col(column).cast("string") == F.col("__value")
        joined = df.join(F.broadcast(ranks.filter(F.col(out) < HOT)), same, "left").drop("__value")
        if self.sizes[column] > HOT:
            rare = joined.filter(F.col(out).isNull() & F.col(column).isNotNull()).drop(out) \
                .join(ranks.filter(F.col(out) >= HOT), same, "left").drop("__value")
            joined = joined.filter(F.col(out).isNotNull() | F.col(column).isNull()).unionByName(rare)
        return joined.filter(F.col(out).isNotNull()) if handle == "skip" else \
            joined.withColumn(out, F.coalesce(F.col(out), F.lit(self.sizes[column]).cast("long")))

    def slot(self, column: str, index: str) -> Column:
        """The one-hot slot of an index: the last label has none (all slots zero)."""
        return F.when(F.col(index) < self.sizes[column] - 1, F.col(index))
