"""Counts, top-k, yearly / monthly / weekday trends and demographic breakdowns.

All are group-by counts: partial aggregation in every task (a hot key is one
row per task before the shuffle), one shuffle of partial counts, a final
merge.  Top-k keeps ``orderBy`` next to ``limit`` so Spark plans a per-task
top-k (TakeOrderedAndProject) instead of a global sort.  Ties are broken by
the key, so results do not depend on partitioning.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions import day_name, month_number, parse_date, year_number
from blotter.sources.layer import DATE_COLUMN, PARTITION_COLUMN

COUNT = "count"


def _n(name: str = COUNT) -> Column:
    return F.count(F.lit(1)).alias(name)


def count_by(df: DataFrame, *columns: str | Column, name: str = COUNT) -> DataFrame:
    """Rows per group (NULL is a group of its own)."""
    return df.groupBy(*columns).agg(_n(name))


def top_k(df: DataFrame, column: str, k: int = 10, name: str = COUNT) -> DataFrame:
    """The ``k`` largest groups of ``column``: count descending, then key ascending."""
    return count_by(df, column, name=name).orderBy(F.col(name).desc(), F.col(column).asc()).limit(k)


def ranked_counts(df: DataFrame, *columns: str, name: str = COUNT) -> DataFrame:
    """All groups, count descending then keys ascending (no limit)."""
    return count_by(df, *columns, name=name).orderBy(F.col(name).desc(), *[F.col(c).asc() for c in columns])


def _date(df: DataFrame, date_col: str) -> Column:
    """The occurrence date: the layer's typed ``occ_date`` when present (same value,
    no per-row parse, filters reach Parquet statistics), else parsed from text."""
    types = dict(df.dtypes)
    if date_col == "date_occ" and types.get(DATE_COLUMN) == "date":
        return F.col(DATE_COLUMN)
    return F.col(date_col) if types[date_col] == "date" else parse_date(date_col)


def _small_sorted(df: DataFrame, *order) -> DataFrame:
    """Total order for a result bounded by the calendar (years, 12 months, 7 days):
    one partition sorted locally, instead of a range shuffle and its sampling job."""
    return df.coalesce(1).sortWithinPartitions(*order)


def year_trend(df: DataFrame, date_col: str = "date_occ", exclude_year: int | None = None) -> DataFrame:
    """Rows per year (``year`` int, ``count``), ascending; with ``exclude_year`` that year and the NULL year dropped.

    The reference drops the current, incomplete year; the filter on the
    grouping key is pushed below the aggregation by Catalyst.
    """
    if date_col == "date_occ" and PARTITION_COLUMN in df.columns:
        year = F.col(PARTITION_COLUMN).alias("year")      # the layer's year folders: no data column read
    else:
        year = year_number(_date(df, date_col)).alias("year")
    out = count_by(df, year)
    if exclude_year is not None:
        # "year != x" is NULL for the NULL year, so that group goes too.
        out = out.filter(F.col("year").isNotNull() & (F.col("year") != exclude_year))
    return _small_sorted(out, "year")


def month_trend(df: DataFrame, start: str, end: str, date_col: str = "date_occ") -> DataFrame:
    """Rows per month number over the half-open date range [start, end), all years folded.

    On the year-partitioned layer the same range also prunes year folders.
    """
    d = _date(df, date_col)
    rng = (d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date"))
    if PARTITION_COLUMN in df.columns:
        y0, y1 = int(start[:4]), int(end[:4])
        rng = (F.col(PARTITION_COLUMN) >= y0) & (F.col(PARTITION_COLUMN) <= y1) & rng
    return _small_sorted(count_by(df.filter(rng), month_number(d).alias("month")), "month")


def weekday_trend(df: DataFrame, weekdays: DataFrame, date_col: str = "date_occ") -> DataFrame:
    """Rows per weekday name in calendar order (``day_of_week``, ``count``).

    The 7-row weekday dimension (fixed size) is broadcast; rows with no valid
    date have no weekday and drop out of the inner join.
    """
    counts = count_by(df, day_name(_date(df, date_col)).alias("day_of_week"))
    joined = counts.join(F.broadcast(weekdays), "day_of_week")
    return _small_sorted(joined, "day_order").drop("day_order")


def by_area(df: DataFrame, value: str, group_col: str = "vict_descent",
            area_col: str = "area_name") -> DataFrame:
    """Rows per area for one group (``area_name``, ``count``); areas without the group are absent."""
    return count_by(df.filter(F.col(group_col) == value), area_col)


def slug(value: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", value.lower()).strip("_")


def area_by_group_wide(df: DataFrame, values: list[str], group_col: str = "vict_descent",
                       area_col: str = "area_name") -> DataFrame:
    """One pass, one row per area, one count per group (zero where absent)."""
    return df.groupBy(area_col).agg(
        *[F.count_if(F.col(group_col) == v).alias(f"n_{slug(v)}") for v in values])


# --- many group-by counts in one pass -------------------------------------------
class GroupedCounts:
    """Counts for several groupings from ONE scan (``GROUPING SETS``), kept for reuse.

    A report of many group-by counts over the same table otherwise scans it
    once per grouping -- at 100 TB, one full round of scan tasks each.  Here
    the rows are expanded once per grouping set inside the scan stage, the
    partial aggregation collapses them per task, one exchange carries the
    partial counts.  The result has one row per group (a size set by the
    vocabularies, not by the rows) and is persisted; each grouping is then a
    filter on ``grouping_id`` over it.  A lost cached block is recomputed by
    the same single pass.
    """

    def __init__(self, df: DataFrame, sets: list[list[str]]):
        self.columns = list(dict.fromkeys(c for s in sets for c in s))
        self.sets = [list(s) for s in sets]
        grouped = df.groupingSets([[F.col(c) for c in s] for s in self.sets],
                                  *[F.col(c) for c in self.columns])
        self.table = grouped.agg(F.count(F.lit(1)).alias(COUNT),
                                 F.grouping_id().alias("__gid")).persist()

    def _gid(self, cols: list[str]) -> int:
        n = len(self.columns)
        return sum(1 << (n - 1 - i) for i, c in enumerate(self.columns) if c not in cols)

    def counts(self, *cols: str, name: str = COUNT) -> DataFrame:
        if list(cols) not in self.sets:
            raise KeyError(f"{cols} is not a grouping set")
        out = self.table.filter(F.col("__gid") == self._gid(list(cols))).select(*cols, COUNT)
        return out.withColumnRenamed(COUNT, name) if name != COUNT else out

    def top_k(self, column: str, k: int = 10) -> DataFrame:
        return self.counts(column).orderBy(F.col(COUNT).desc(), F.col(column).asc()).limit(k)

    def ranked(self, *cols: str) -> DataFrame:
        return self.counts(*cols).orderBy(F.col(COUNT).desc(), *[F.col(c).asc() for c in cols])

    def by_area(self, value: str, group_col: str = "vict_descent", area_col: str = "area_name") -> DataFrame:
        return self.counts(area_col, group_col).filter(F.col(group_col) == value).select(area_col, COUNT)

    def area_wide(self, values: list[str], group_col: str = "vict_descent",
                  area_col: str = "area_name") -> DataFrame:
        pairs = self.counts(area_col, group_col)
        return pairs.groupBy(area_col).agg(
            *[F.sum(F.when(F.col(group_col) == v, F.col(COUNT)).otherwise(F.lit(0))).alias(f"n_{slug(v)}")
              for v in values])

    def weekday(self, weekdays: DataFrame, column: str = "day_of_week") -> DataFrame:
        """:func:`weekday_trend` from the ``[day_of_week]`` set (NULL weekday drops out of the join)."""
        joined = self.counts(column).join(F.broadcast(weekdays), column)
        return _small_sorted(joined, "day_order").drop("day_order")

    def release(self) -> None:
        self.table.unpersist()
