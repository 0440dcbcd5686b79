"""Dates parsed from the normalised ``MM-dd-yyyy`` text, and their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blotter.functions.casts import _col

# --- fixed values: the normalised date text pattern ------------------------
DATE_FORMAT = "MM-dd-yyyy"


def parse_date(c: str | Column, fmt: str = DATE_FORMAT) -> Column:
    """Text -> date; text that is not a valid date -> NULL (never throws)."""
    return F.try_to_date(_col(c), fmt)


def year_number(d: Column) -> Column:
    return F.year(d)


def month_number(d: Column) -> Column:
    return F.month(d)


def month_name(d: Column) -> Column:
    """Full English month name, ``"March"``; NULL date -> NULL."""
    return F.date_format(d, "MMMM")


def day_name(d: Column) -> Column:
    """Full English weekday name, ``"Sunday"``; NULL date -> NULL."""
    return F.date_format(d, "EEEE")
