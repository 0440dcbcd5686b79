"""The exploratory report over the cleaned layer: every table behind the charts.

Each entry is a lazy DataFrame; nothing is collected here.  On the
year-partitioned layer, the date-range query prunes year folders and every
query reads only the columns it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blotter.operators import trends
from blotter.sources.dims import weekday_dim

# --- fixed values: demographic groups broken down by area ------------------
AREA_GROUPS = ["Hispanic/Latin", "Black", "White"]


# The plain group-by counts of the report, computed together by ``single_pass``.
REPORT_SETS = [["crm_cd_desc"], ["weapon_desc"], ["area_name"], ["vict_descent"], ["vict_sex"],
               ["vict_age"], ["vict_age", "vict_sex"], ["area_name", "vict_descent"], ["day_of_week"]]


class Report(dict):
    """Tables by name; :meth:`release` drops what they share."""

    grouped: trends.GroupedCounts | None = None

    def release(self) -> None:
        if self.grouped is not None:
            self.grouped.release()


def area_names(groups: list[str]) -> dict[str, str]:
    """The table name of each group: its first word, or all of it where two groups begin alike."""
    first = {v: trends.slug(v).split("_")[0] for v in groups}
    short = list(first.values())
    return {v: f"count_by_area_{s if short.count(s) == 1 else trends.slug(v)}" for v, s in first.items()}


def eda_report(spark: SparkSession, clean: DataFrame, month_range: tuple[str, str],
               exclude_year: int | None = None, k: int = 10,
               groups: list[str] = AREA_GROUPS, single_pass: bool = False) -> Report:
    """Every table behind the charts.

    With ``single_pass`` the eleven plain group-by tables and the weekday trend
    come from one GROUPING SETS pass over the layer (:class:`trends.GroupedCounts`)
    instead of one scan each; the year trend reads only the year folders and the
    month trend keeps its own pruned, date-filtered scan.
    """
    if single_pass:
        with_day = clean.withColumn("day_of_week", trends.day_name(trends._date(clean, "date_occ")))
        g = trends.GroupedCounts(with_day, REPORT_SETS)
        report = Report({
            "top_crime": g.top_k("crm_cd_desc", k),
            "top_weapon": g.top_k("weapon_desc", k),
            "top_area": g.top_k("area_name", k),
            "top_descent": g.top_k("vict_descent", k),
            "count_by_sex": g.counts("vict_sex", name="crime_count"),
            "age_dist": g.ranked("vict_age"),
            "age_sex_dist": g.ranked("vict_age", "vict_sex"),
            "year_trend": trends.year_trend(clean, exclude_year=exclude_year),
            "month_trend": trends.month_trend(clean, *month_range),
            "weekday_trend": g.weekday(weekday_dim(spark)),
            "area_by_group_wide": g.area_wide(groups),
        })
        report.grouped = g
        for v, name in area_names(groups).items():
            report[name] = g.by_area(v)
        return report
    report = Report({
        "top_crime": trends.top_k(clean, "crm_cd_desc", k),
        "top_weapon": trends.top_k(clean, "weapon_desc", k),
        "top_area": trends.top_k(clean, "area_name", k),
        "top_descent": trends.top_k(clean, "vict_descent", k),
        "count_by_sex": trends.count_by(clean, "vict_sex", name="crime_count"),
        "age_dist": trends.ranked_counts(clean, "vict_age"),
        "age_sex_dist": trends.ranked_counts(clean, "vict_age", "vict_sex"),
        "year_trend": trends.year_trend(clean, exclude_year=exclude_year),
        "month_trend": trends.month_trend(clean, *month_range),
        "weekday_trend": trends.weekday_trend(clean, weekday_dim(spark)),
        "area_by_group_wide": trends.area_by_group_wide(clean, groups),
    })
    for v, name in area_names(groups).items():
        report[name] = trends.by_area(clean, v)
    return report
