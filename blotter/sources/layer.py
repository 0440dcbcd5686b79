"""The cleaned Parquet layer, partitioned by occurrence year.

The raw CSV is parsed once; every later query reads the columnar layer, so
column pruning and predicate pushdown reach the files and date-range
queries prune whole year folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.functions import parse_date

PARTITION_COLUMN = "occ_year"
DATE_COLUMN = "occ_date"


def with_partition_year(df: DataFrame, date_col: str = "date_occ") -> DataFrame:
    """Add ``occ_date`` (the parsed occurrence date, DATE) and ``occ_year`` (its year).

    The text column stays as the cleaned contract has it; the typed copy lets
    date-range filters reach the Parquet row-group statistics and spares every
    query a text parse per row.
    """
    return df.withColumn(DATE_COLUMN, parse_date(date_col)).withColumn(PARTITION_COLUMN, F.year(DATE_COLUMN))


def write_layer(df: DataFrame, path: str, date_col: str = "date_occ",
                mode: str = "overwrite") -> None:
    """Write the layer, one folder per year; rows with no valid date go to the NULL folder.

    Rows are clustered by year with a REBALANCE hint, not ``repartition``:
    a year holds an eighth of all rows or more, and ``repartition(year)``
    would send each year to one task.  REBALANCE lets AQE split a large year
    into advisory-size partitions (several files per year folder) and merge
    small ones, so each task writes few, evenly sized files.
    """
    out = with_partition_year(df, date_col)
    (out.hint("rebalance", PARTITION_COLUMN)
        .write.mode(mode)
        .partitionBy(PARTITION_COLUMN)
        .parquet(path))


def write_raw_layer(raw: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The raw incidents, still all text, as Parquet: the CSV is parsed once.

    Profiles of the raw data (NULL counts, distinct values, unmapped values),
    the cleaning flow and the classifier then read only the columns they
    name instead of re-parsing every CSV line.  No shuffle: one file per
    input split.
    """
    raw.write.mode(mode).parquet(path)


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
