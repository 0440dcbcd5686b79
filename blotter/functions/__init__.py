"""Column expressions (JVM-side built-ins only, so whole-stage codegen holds)."""

from blotter.functions.casts import to_double, to_int
from blotter.functions.dates import (
    DATE_FORMAT,
    day_name,
    month_name,
    month_number,
    parse_date,
    year_number,
)
from blotter.functions.text import date_text, time_text

__all__ = [
    "DATE_FORMAT", "date_text", "day_name", "month_name", "month_number",
    "parse_date", "time_text", "to_double", "to_int", "year_number",
]
