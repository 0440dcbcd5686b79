"""Raw incident files as they land -> the cleaned, year-partitioned Parquet layer.

The same column expressions and dictionary joins as the batch flow run on a
``readStream`` CSV source: the dictionaries are validated once when the
query starts and joined as static broadcast relations (stream-static left
joins), so each micro-batch is one narrow stage.  The Parquet file sink with
a checkpoint location in the shared folder is exactly-once: a lost executor
or a restarted query re-runs the unfinished batch, never a committed one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from blotter.operators.recode import CheckedDim
from blotter.plans.cleaning import clean_incidents
from blotter.schema import RAW_SCHEMA, normalize_names
from blotter.sources.layer import PARTITION_COLUMN, with_partition_year


def raw_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Incident CSV files appearing under ``source_dir``, every column as text."""
    reader = spark.readStream.schema(RAW_SCHEMA).option("header", True).option("enforceSchema", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return normalize_names(reader.csv(source_dir))


def clean_stream(spark: SparkSession, source_dir: str, dim: DataFrame | CheckedDim,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    return with_partition_year(clean_incidents(raw_stream(spark, source_dir, max_files_per_trigger), dim))


def start_ingest(spark: SparkSession, source_dir: str, layer_path: str, checkpoint_location: str,
                 dim: DataFrame | CheckedDim, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest; ``available_now`` processes every file present, then stops."""
    out = clean_stream(spark, source_dir, dim, max_files_per_trigger)
    writer = (out.writeStream.format("parquet")
                 .partitionBy(PARTITION_COLUMN)
                 .option("path", layer_path)
                 .option("checkpointLocation", checkpoint_location)
                 .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
