"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.session import shared_dir, tidy

#: Two to the 53rd: hashes are reduced to this many values before they become doubles.
UNIT = 1 << 53


_made: list[str] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that :func:`written` has made inside it; results must have been written by then."""
    n = len(_made)
    try:
        yield
    finally:
        own, _made[n:] = _made[n:], []
        for path in own:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder, read again (by folders of ``partition``, if given).

    This is the lineage cut of the subpackage: what is downstream reads files
    that every executor can reach, so a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with tidy(spark):
        (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unit(*cols: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the values of ``cols`` alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(UNIT)).cast("double") / F.lit(float(UNIT))


def chunks_for(rows: int, per_chunk: int) -> int:
    return max(1, math.ceil(rows / per_chunk))


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, beside columns of our own: no name can clash."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in more.items()))


def lookup(left: DataFrame, right: DataFrame, on: list[str], most: int = 1000, rows: int | None = None) -> DataFrame:
    """Left join of ``left`` (read more than once: a written table of ``rows`` rows) with ``right``, whose keys are unique.

    Keys that hold more than one in ``most`` of the left rows would each land in
    one task.  There are fewer than ``most`` of them by arithmetic, so their
    right rows are broadcast; all other keys are joined by a shuffle.
    """
    rows = left.count() if rows is None else rows
    keys = left.groupBy(*on).count().filter(F.col("count") * most > rows).select(*on).collect()
    if not keys:
        return left.join(right, on, "left")
    marks = F.broadcast(left.sparkSession.createDataFrame(keys, left.select(*on).schema).withColumn("_hot", F.lit(True)))
    marked = left.join(marks, on, "left")
    few = F.broadcast(right.join(marks, on, "left_semi"))
    often = marked.filter("_hot").drop("_hot").join(few, on, "left")
    return marked.filter("_hot is null").drop("_hot").join(right, on, "left").unionByName(often)
