"""Positions and running sums over a whole table, without sorting it in one task.

Rows are range-sorted over the cluster; a partition numbers or sums its own rows,
and the partitions' totals -- one row each, all that reaches the driver -- give
each partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.session import stored

_ROW_BITS = (1 << 33) - 1       # monotonically_increasing_id: the partition above, the row below these bits


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-sorted and stored, with __part and __near (place within the partition)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(placed.select("*", F.spark_partition_id().alias("__part"),
                                F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("__near")), "placed")


def _offsets(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(__part, __before_<name>): the totals of all earlier partitions, one row per partition."""
    rows = sorted(tuple(r) for r in placed.groupBy("__part").agg(*(c.alias(n) for n, c in sums.items())).collect())
    at, out = [0] * len(sums), []
    for part, *own in rows:
        out.append((part, *at))
        at = [a + (x or 0) for a, x in zip(at, own)]
    kind = ", ".join(["__part int", *(f"__before_{n} long" for n in sums)])
    return F.broadcast(placed.sparkSession.createDataFrame(out, kind))


def dense_positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, 0, 1, 2 ... in the order given."""
    placed = _placed(df, order)
    known = _offsets(placed, {"n": F.count(F.lit(1))})
    return placed.join(known, "__part").select(*df.columns, (F.col("__before_n") + F.col("__near")).alias(name))


def running_sums(df: DataFrame, order: list[Column], names: list[str], prefix: str = "before_") -> DataFrame:
    """``df`` with the sums of the columns ``names`` (long) over all earlier rows."""
    placed = _placed(df, order)
    known = _offsets(placed, {n: F.sum(n) for n in names})
    earlier = Window.partitionBy("__part").orderBy("__near").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__in_{n}") for n in names))
    return inside.join(known, "__part").select(*df.columns, *((F.col(f"__in_{n}") + F.col(f"__before_{n}")).alias(prefix + n) for n in names))
