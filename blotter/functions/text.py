"""Text normalisation of the raw date and time fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blotter.functions.casts import _col


def date_text(c: str | Column) -> Column:
    """``"03/01/2020 12:00:00 AM"`` -> ``"03-01-2020"``.

    Keeps the first ten characters (the date part) and turns every ``/``
    into ``-``.  NULL stays NULL.
    """
    return F.translate(F.substring(_col(c), 1, 10), "/", "-")


def time_text(c: str | Column) -> Column:
    """Unpadded ``HHMM`` digits -> ``"HH:mm"``.

    ``"45"`` -> ``"00:45"``, ``"2130"`` -> ``"21:30"``.  ``lpad`` to four
    characters also cuts longer text to its first four (``"12345"`` ->
    ``"12:34"``).  NULL stays NULL.
    """
    padded = F.lpad(_col(c), 4, "0")
    return F.concat(F.substring(padded, 1, 2), F.lit(":"), F.substring(padded, 3, 2))
