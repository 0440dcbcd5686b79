"""A layer whose files can be skipped by any of several columns.

Rows are laid out along a Morton curve: each column's value becomes a bucket number
by bounds taken from a sample (equal shares of the rows, so a skewed column gives even
buckets), the bits of the bucket numbers are interleaved, and files hold ranges of the
result.  A file then spans a small box in all columns at once.  A manifest next to the
data holds each file's rows and its least and greatest value of each column; a filter reads
the manifest first and opens only the files whose box meets it.

The sample only shapes the files: bounds that fit badly make larger boxes, never wrong results.
NULL has bucket 0 and is noted in the manifest, so a file with NULLs is not skipped by a NULL test.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.session import stored

#: Bits of one column's bucket number.
BITS = 6
#: Rows that bounds are taken from, about.
SAMPLE = 100_000


def bounds(df: DataFrame, column: str, bits: int = BITS, sample: int = SAMPLE) -> list:
    """Up to ``2**bits - 1`` cuts of a column, of equal shares of a sample of about ``sample`` rows."""
    known = df.select(column).filter(F.col(column).isNotNull())
    rows = known.count()
    part = known.sample(min(1.0, sample / rows), seed=5) if rows > sample else known
    values = sorted(r[0] for r in part.limit(2 * sample).collect())     # a bounded sample: it shapes files only
    n = 1 << bits
    cuts = [values[len(values) * i // n] for i in range(1, n)] if values else []
    return sorted(set(cuts))


def bucket(column: str, cuts: list, kind: T.DataType) -> Column:
    """The number of cuts at or below the value (NULL: 0)."""
    if not cuts:
        return F.lit(0)
    held = F.array(*(F.lit(c).cast(kind) for c in cuts))
    return F.coalesce(F.size(F.filter(held, lambda c: c <= F.col(column))), F.lit(0))


def morton(buckets: list[Column], bits: int = BITS) -> Column:
    """The bits of the bucket numbers in turn, the highest first."""
    out = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for b in buckets:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(b, bit).bitwiseAND(F.lit(1)).cast("long"))
    return out


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int, bits: int = BITS) -> None:
    """Write ``df`` as about ``files`` files along the curve, and their manifest.

    The rows are computed once, into the shared folder: the bounds and the range sort read them several times.
    """
    df = stored(df, "unclustered")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    key = morton([bucket(c, bounds(df, c, bits), kinds[c]) for c in columns], bits)
    # equal keys (one crowded cell) are still dealt over several files, by a hash of the row
    spread = F.xxhash64(*df.columns)
    laid = df.withColumn("__z", key).repartitionByRange(files, "__z", spread).sortWithinPartitions("__z").drop("__z")
    laid.write.mode("overwrite").parquet(f"{path}/data")
    _manifest_of(df.sparkSession, path, df.schema, columns).write.mode("overwrite").parquet(f"{path}/manifest")


def _manifest_of(spark: SparkSession, path: str, schema: T.StructType, columns: list[str]) -> DataFrame:
    data = spark.read.schema(schema).parquet(f"{path}/data").withColumn("__file", F.col("_metadata.file_name"))
    each = [x for c in columns for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"))]
    return data.groupBy(F.col("__file").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *each).coalesce(max(1, math.ceil(len(columns) / 8)))


class Clustered:
    """A clustered layer to be read with conditions on its columns."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self.manifest = spark.read.parquet(f"{path}/manifest")

    def files(self, **conditions: tuple | str | int) -> list[str]:
        """The files that may hold rows of the conditions: a value, or (least, below): a half-open range, None for an open end."""
        hit = F.lit(True)
        for c, x in conditions.items():
            low, high = x if isinstance(x, tuple) else (x, None)
            if low is not None:
                hit = hit & (F.col(f"max_{c}") >= F.lit(low))
            if isinstance(x, tuple):
                hit = hit if high is None else hit & (F.col(f"min_{c}") < F.lit(high))
            else:
                hit = hit & (F.col(f"min_{c}") <= F.lit(x))
        return sorted(r["file"] for r in self.manifest.filter(hit).select("file").collect())    # names of files, not rows

    def read(self, **conditions: tuple | str | int) -> DataFrame:
        """The rows that meet the conditions, from the files that may hold some."""
        files = self.files(**conditions)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in files))
        for c, x in conditions.items():
            if isinstance(x, tuple):
                for bound, test in ((x[0], F.col(c).__ge__), (x[1], F.col(c).__lt__)):
                    df = df if bound is None else df.filter(test(F.lit(bound)))
            else:
                df = df.filter(F.col(c) == F.lit(x))
        return df
