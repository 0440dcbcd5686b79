"""Safe casts of raw text.

Spark 4 runs with ANSI mode on, where ``cast`` throws on bad text.  Raw
incident files carry such text, so every cast from raw is a ``try_cast``:
bad text becomes NULL and is then handled by the NULL rules of the filters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int(c: str | Column) -> Column:
    """Text -> int; ``"x"``, ``""``, overflow -> NULL."""
    return _col(c).try_cast("int")


def to_double(c: str | Column) -> Column:
    """Text -> double; bad text -> NULL."""
    return _col(c).try_cast("double")
