"""Cleaning: drop code columns, type, normalise dates and times, NULL-explicit filters.

Every rule is a column expression, so the whole cleaning flow is one
narrow stage (scan -> project -> filter) with no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions import date_text, day_name, month_name, parse_date, time_text, to_double, to_int
from blotter.schema import DROPPED

# --- fixed values: victim-age sentinels that mean "not an age" -------------
AGE_SENTINELS = [-2, -1, 0]
# --- fixed values: victim-sex codes dropped by cleaning (besides NULL) -----
SEX_DROPPED = ["null", "H"]
# --- fixed values: placeholder items removed before rule mining ------------
PLACEHOLDERS = ["Unknown", "Other"]


def drop_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.drop(*(columns if columns is not None else DROPPED))


def cast_columns(df: DataFrame, ints: list[str] = (), doubles: list[str] = ()) -> DataFrame:
    """``try_cast`` text columns in one projection: bad text -> NULL, never an error."""
    casts = {c: to_int(c) for c in ints}
    casts.update({c: to_double(c) for c in doubles})
    return df.withColumns(casts) if casts else df


def normalize_dates(df: DataFrame, columns: list[str] = ("date_rptd", "date_occ")) -> DataFrame:
    """Date text ``MM/dd/yyyy ...`` -> ``MM-dd-yyyy`` (first ten characters, ``/`` -> ``-``)."""
    return df.withColumns({c: date_text(c) for c in columns if c in df.columns})


def normalize_time(df: DataFrame, column: str = "time_occ") -> DataFrame:
    """Unpadded ``HHMM`` -> ``HH:mm``."""
    return df.withColumn(column, time_text(column))


def add_month_day(df: DataFrame, date_col: str = "date_occ") -> DataFrame:
    """``month`` / ``day``: full month and weekday names of the normalised date (NULL if invalid)."""
    named = df.withColumn("__date", parse_date(date_col))      # a projection of its own: the text is parsed once
    return named.withColumns({"month": month_name(F.col("__date")), "day": day_name(F.col("__date"))}).drop("__date")


def not_in(c: str, values: list) -> Column:
    """Keep rows whose value is known and not listed.  NULL is dropped, said openly."""
    return F.col(c).isNotNull() & ~F.col(c).isin(*values)


def valid_rows(age: str = "vict_age", sex: str = "vict_sex",
               not_null_text: tuple[str, ...] = ("vict_descent", "premis_desc", "weapon_desc")) -> Column:
    """The cleaning filter as one predicate.

    * age: not NULL and not a sentinel (-2, -1, 0); other negatives stay;
    * sex: not NULL, not ``null``, not ``H``;
    * descent, premise, weapon: not NULL and not the text ``null``.
    """
    preds = [not_in(age, AGE_SENTINELS), not_in(sex, SEX_DROPPED)]
    preds += [not_in(c, ["null"]) for c in not_null_text]
    return reduce(lambda a, b: a & b, preds)


def filter_valid(df: DataFrame, **kw) -> DataFrame:
    return df.filter(valid_rows(**kw))


def no_placeholders(columns: list[str], placeholders: list[str] = PLACEHOLDERS) -> Column:
    """True iff every column is non-NULL and none holds a placeholder (``Unknown``/``Other``)."""
    return reduce(lambda a, b: a & b, [not_in(c, placeholders) for c in columns])


def filter_placeholders(df: DataFrame, columns: list[str],
                        placeholders: list[str] = PLACEHOLDERS) -> DataFrame:
    return df.filter(no_placeholders(columns, placeholders))


def filter_counts(df: DataFrame) -> DataFrame:
    """How many rows each cleaning rule removes (one pass; a row may fail several rules)."""
    rules = {
        "bad_age": ~not_in("vict_age", AGE_SENTINELS),
        "bad_sex": ~not_in("vict_sex", SEX_DROPPED),
        "bad_descent": ~not_in("vict_descent", ["null"]),
        "bad_premise": ~not_in("premis_desc", ["null"]),
        "bad_weapon": ~not_in("weapon_desc", ["null"]),
        "kept": valid_rows(),
    }
    return df.agg(*[F.sum(p.cast("long")).alias(k) for k, p in rules.items()])
