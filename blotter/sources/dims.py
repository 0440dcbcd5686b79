"""Small dimension tables: the weekday order and recode dictionaries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: calendar order of the weekday names (Monday first) ------
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# --- fixed values: victim sex codes and their descriptions -----------------
SEX_CODES = {"F": "Female", "M": "Male", "X": "Unknown"}

# --- fixed values: victim descent codes and their descriptions -------------
DESCENT_CODES = {
    "A": "Other Asian", "B": "Black", "C": "Chinese", "D": "Cambodian", "F": "Filipino",
    "G": "Guamanian", "H": "Hispanic/Latin", "I": "American Indian/Alaskan Native",
    "J": "Japanese", "K": "Korean", "L": "Laotian", "O": "Other", "P": "Pacific Islander",
    "S": "Samoan", "U": "Hawaiian", "V": "Vietnamese", "W": "White", "X": "Unknown",
    "Z": "Asian Indian",
}

WEEKDAY_SCHEMA = T.StructType([
    T.StructField("day_of_week", T.StringType(), False),
    T.StructField("day_order", T.LongType(), False),
])

RECODE_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType(), False),
    T.StructField("raw", T.StringType(), True),
    T.StructField("target", T.StringType(), True),
])


def weekday_dim(spark: SparkSession) -> DataFrame:
    """Seven rows (``day_of_week``, ``day_order``), Monday = 0 ... Sunday = 6."""
    return spark.createDataFrame([(d, i) for i, d in enumerate(WEEKDAYS)], WEEKDAY_SCHEMA)


def recode_dim(spark: SparkSession,
               entries: Mapping[str, Mapping[str, str]] | Iterable[tuple[str, str, str]]) -> DataFrame:
    """A ``recode_dim(domain, raw, target)`` table from ``{domain: {raw: target}}`` or triples.

    Triples may repeat a key (as real dictionaries do); :func:`blotter.operators.recode.dim_check`
    rejects a key mapped to two targets and de-duplicates the rest.
    """
    if isinstance(entries, Mapping):
        rows = [(d, k, v) for d, m in entries.items() for k, v in m.items()]
    else:
        rows = list(entries)
    return spark.createDataFrame(rows, RECODE_SCHEMA)
