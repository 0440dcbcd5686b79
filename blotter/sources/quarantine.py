"""Malformed CSV lines set apart, in one pass over the files.

The files are read as lines; a line is checked for its structure and parsed by
the same expression stage, and every line goes to exactly one of three folders of
one Parquet write: headers, rows, or rejected lines with file, reason and number of fields.
So ``lines read = headers + rows + rejected lines`` by construction, and nothing is
filled up with NULL or cut off in silence.

Reasons, the first that holds: ``empty`` (white space only), ``quote`` (a quote that the
line does not close), ``few`` and ``many`` (fields against the schema).  A header is known by its
text.  A file that has lines but not this header may hold its columns in another order, so it
stops the split, as it stops :func:`blotter.sources.csv.read_raw_csv`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.schema import RAW_SCHEMA, normalize_names
from blotter.session import shared_dir

CLEAN, REJECTED, HEADER = "clean", "rejected", "header"
_QUOTED = r'"([^"\\]|\\.|"")*"'


def header_of(schema: T.StructType) -> str:
    return ",".join(f.name for f in schema.fields)


class SplitLines:
    """Rows, rejected lines and headers of CSV files, written once below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def rows(self, normalize: bool = True) -> DataFrame:
        df = self._part(CLEAN).select(*(F.col("row").getField(f.name).alias(f.name) for f in self.schema.fields))
        return normalize_names(df) if normalize else df

    def rejected(self) -> DataFrame:
        """(file, line, reason, fields)"""
        return self._part(REJECTED).select("file", "line", "reason", "fields")

    def counts(self) -> DataFrame:
        """(outcome, reason, lines); only rejected lines have a reason."""
        return self._all().groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("lines"))

    def _all(self) -> DataFrame:
        kind = T.StructType([T.StructField("row", self.schema), T.StructField("file", T.StringType()), T.StructField("line", T.StringType()),
                             T.StructField("reason", T.StringType()), T.StructField("fields", T.IntegerType()), T.StructField("outcome", T.StringType())])
        return self.spark.read.schema(kind).parquet(self.path)

    def _part(self, outcome: str) -> DataFrame:
        return self._all().filter(F.col("outcome") == outcome)


def split_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> SplitLines:
    """Split the CSV files below ``path`` (with headers, every column as text) into rows and rejected lines."""
    header = header_of(schema)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    # columns of their own, each computed once a line; only a line with a quote needs the pattern
    quoted = F.contains("line", F.lit('"'))
    lines = lines.withColumn("bare", F.when(quoted, F.regexp_replace("line", _QUOTED, "")).otherwise(F.col("line")))
    lines = lines.withColumn("n_fields", F.length("bare") - F.length(F.translate("bare", ",", "")) + 1)
    fields, open_quote = F.col("n_fields"), F.contains("bare", F.lit('"'))
    reason = (F.when(~F.rlike("line", F.lit(r"\S")), "empty").when(open_quote, "quote")
              .when(fields < len(schema), "few").when(fields > len(schema), "many"))
    checked = lines.withColumn("is_header", F.col("line") == header).withColumn("reason", F.when(~F.col("is_header"), reason))
    good, bad = ~F.col("is_header") & F.col("reason").isNull(), F.col("reason").isNotNull()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    out = checked.select(F.when(good, F.from_csv("line", ddl, {"mode": "PERMISSIVE"})).alias("row"), "file", F.when(bad, F.col("line")).alias("line"),
                         "reason", F.when(bad, fields).cast("int").alias("fields"),
                         F.when(good, CLEAN).when(bad, REJECTED).otherwise(HEADER).alias("outcome"))
    target = shared_dir(spark, "split-csv")
    out.write.partitionBy("outcome").parquet(target)
    split = SplitLines(spark, target, schema)
    files = split._all().groupBy("file").agg(F.max(F.col("outcome") == HEADER).alias("has_header"))
    without = [r["file"] for r in files.filter("not has_header").select("file").limit(10).collect()]
    if without:
        raise ValueError(f"files without the header {header}: {without}")
    return split
