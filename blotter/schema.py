"""Schemas and column names of the incident tables.

Raw incident files are CSV with a header and every column read as text;
nothing is inferred.  Inside the library all names are snake_case, made
from the header by one rule (:func:`snake`), so ``"Vict Age"`` becomes
``vict_age``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: the raw header of an incident file, in file order -------
RAW_COLUMNS = [
    "DR_NO", "Date Rptd", "Date OCC", "TIME OCC", "AREA", "AREA NAME",
    "Rpt Dist No", "Part 1-2", "Crm Cd", "Crm Cd Desc", "Mocodes",
    "Vict Age", "Vict Sex", "Vict Descent", "Premis Cd", "Premis Desc",
    "Weapon Used Cd", "Weapon Desc", "Status", "Status Desc",
    "Crm Cd 1", "Crm Cd 2", "Crm Cd 3", "Crm Cd 4",
    "LOCATION", "Cross Street", "LAT", "LON",
]

# --- fixed values: columns dropped by cleaning as redundant codes ----------
DROPPED_COLUMNS = [
    "DR_NO", "AREA", "Rpt Dist No", "Part 1-2", "Crm Cd", "Mocodes",
    "Premis Cd", "Weapon Used Cd", "Status", "Crm Cd 1", "Crm Cd 2",
    "Crm Cd 3", "Crm Cd 4", "Cross Street",
]


def snake(name: str) -> str:
    """``"Crm Cd Desc"`` -> ``"crm_cd_desc"``; ``"Part 1-2"`` -> ``"part_1_2"``."""
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


RAW = [snake(c) for c in RAW_COLUMNS]
DROPPED = [snake(c) for c in DROPPED_COLUMNS]

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

# Cleaned layer: raw minus the dropped codes and the report date, plus the
# month and weekday names of the occurrence date.
CLEAN_COLUMNS = [
    "date_occ", "time_occ", "area_name", "crm_cd_desc", "vict_age", "vict_sex",
    "vict_descent", "premis_desc", "weapon_desc", "status_desc", "location",
    "lat", "lon", "month", "day",
]

CLEAN_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType() if c == "vict_age" else T.StringType(), True)
     for c in CLEAN_COLUMNS]
)

# Five basket columns of the association-rule mining step.
BASKET_COLUMNS = ["area_name", "crm_cd_desc", "premis_desc", "weapon_desc", "vict_descent"]


def normalize_names(df: DataFrame) -> DataFrame:
    """Rename every column by :func:`snake` in one projection."""
    return df.toDF(*[snake(c) for c in df.columns])
