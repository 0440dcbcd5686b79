"""Profiling: row count, NULL profile, distinct values, ordered preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    """One row, ``row_count`` bigint (partial counts per task, one tiny final merge)."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row, one bigint per column: how many values are NULL.  One pass over the data."""
    cols = columns or df.columns
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])


def null_profile_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The NULL profile as rows (``column_name``, ``null_count``); same single pass."""
    wide = null_profile(df, columns)
    cols = columns or df.columns
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, null_count)")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column (partial distinct per task, then one shuffle)."""
    return df.select(column).distinct()


def distinct_values_many(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of several columns in one pass: (``column_name``, ``value``).

    Each row is unpivoted into (name, value) pairs and de-duplicated once, so
    the table is scanned and shuffled once, not once per column.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    return df.select(pairs.alias("p")).select("p.column_name", "p.value").distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their counts (``value``, ``n``)."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def preview(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    """First ``n`` rows in a stated order, so the preview is deterministic (top-k, no full sort)."""
    return df.orderBy(*order_by).limit(n)


class ValueCounts:
    """(``column_name``, ``value``, ``n``) for several categorical columns from ONE pass, kept.

    Distinct values and the unmapped-value report both start from these
    counts; computing them once costs one scan of the union of their columns
    instead of one scan per report.  Each row is unpivoted to (name, value)
    pairs and counted with partial aggregation, so a hot value is one row per
    task before the shuffle.  The result has one row per distinct value per
    column -- use it for vocabulary columns, not for keys or free text.
    """

    def __init__(self, df: DataFrame, columns: list[str]):
        self.columns = list(dict.fromkeys(columns))
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                             F.col(c).cast("string").alias("value"))
                                    for c in self.columns]))
        self.table = (df.select(pairs.alias("p")).select("p.column_name", "p.value")
                        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
                        .persist())

    def distinct_values(self, columns: list[str]) -> DataFrame:
        """Same rows as :func:`distinct_values_many`."""
        return self.table.filter(F.col("column_name").isin(*columns)).select("column_name", "value")

    def release(self) -> None:
        self.table.unpersist()
