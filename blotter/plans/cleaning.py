"""Raw incidents -> cleaned incidents: the whole cleaning flow as one lazy plan.

scan -> drop code columns -> try_cast age -> date/time text -> recode five
columns (broadcast joins, no shuffle) -> month/day names -> NULL-explicit
filters -> the cleaned schema.  No action runs here except the small
dictionary checks of :func:`blotter.operators.recode.dim_check`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from blotter.operators.clean import (
    add_month_day,
    cast_columns,
    drop_columns,
    filter_valid,
    normalize_dates,
    normalize_time,
)
from blotter.operators.recode import CheckedDim, check_dim, merge_passes, recode_many
from blotter.schema import CLEAN_COLUMNS

# Column -> dictionary domain used by the cleaning flow.
RECODE_DOMAINS = {
    "vict_sex": "sex",
    "vict_descent": "descent",
    "crm_cd_desc": "crime",
    "premis_desc": "premise",
    "weapon_desc": "weapon",
}


def typed_incidents(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop the code columns (but ``keep``), type the age, normalise date and time text."""
    from blotter.schema import DROPPED
    df = drop_columns(raw, [c for c in DROPPED if c not in keep])
    df = cast_columns(df, ints=["vict_age"])
    df = normalize_dates(df)
    return normalize_time(df)


def recoded_incidents(raw: DataFrame, dim: DataFrame | CheckedDim,
                      second_passes: dict[str, str] | None = None) -> DataFrame:
    """:func:`typed_incidents` plus the five recodes (premise in two passes, merged)."""
    return _recode(typed_incidents(raw), dim, second_passes)


def _recode(df: DataFrame, dim: DataFrame | CheckedDim, second_passes: dict[str, str] | None) -> DataFrame:
    second_passes = {"premise": "premise_pass2"} if second_passes is None else second_passes
    dim = check_dim(dim)
    for first, second in second_passes.items():
        dim = merge_passes(dim, first, second)
    return recode_many(df, dim, RECODE_DOMAINS)


def clean_incidents(raw: DataFrame, dim: DataFrame | CheckedDim,
                    second_passes: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The cleaned incident table (``blotter.schema.CLEAN_COLUMNS``).

    ``keep`` names raw columns to carry along in front (e.g. ``("dr_no",)`` as
    a key for a deterministic split); by default the codes are dropped.
    """
    df = typed_incidents(raw, keep)
    df = _recode(df, dim, second_passes).drop("date_rptd")
    df = add_month_day(df)
    return filter_valid(df).select(*keep, *CLEAN_COLUMNS)
