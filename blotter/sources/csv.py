"""The CSV edge: incident files are read with a header and every column as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from blotter.schema import RAW_SCHEMA, normalize_names
from blotter.session import tidy

#: Rows of a packed file at most: it can't be split, so one task reads all of it.
ROWS_PER_FILE = 100_000


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
                 normalize: bool = True) -> DataFrame:
    """Read incident CSV with an explicit all-string schema (no inference pass).

    An empty field reads as NULL; the text ``null`` stays text.  With
    ``normalize`` the header names become snake_case.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .csv(path)
    )
    return normalize_names(df) if normalize else df


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with a header, every column as text (schema from the header only)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def _packing(packed: bool) -> dict[str, str | int]:
    return {"compression": "gzip", "maxRecordsPerFile": ROWS_PER_FILE} if packed else {}


def land_parts(df: DataFrame, path: str, part: Column) -> None:
    """Add packed CSV files as :func:`write_csv` writes them, into one folder ``part=<value>`` per value of ``part``, in one pass over ``df``."""
    with tidy(df.sparkSession):
        df.withColumn("part", part).write.mode("append").partitionBy("part").options(header=True, **_packing(True)).csv(path)


def has_folder(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder within one file system, its parent made first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    src, dst = path(source), path(target)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise OSError(f"{source} was not moved to {target}")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", packed: bool = False) -> None:
    """Write with a header; every value as its text; NULL as an empty field. ``packed``: in gzip files of some rows each."""
    with tidy(df.sparkSession):
        df.write.mode(mode).options(header=True, **_packing(packed)).csv(path)
