from blotter.operators.trends import (
    area_by_group_wide,
    by_area,
    count_by,
    month_trend,
    top_k,
    weekday_trend,
    year_trend,
)
from blotter.sources.dims import WEEKDAYS, weekday_dim


def test_top_k_ties_broken_by_key(spark):
    df = spark.createDataFrame([(k,) for k in ["b", "a", "c", "c", "d"]], "k string")
    got = [tuple(r) for r in top_k(df, "k", 3).collect()]
    assert got == [("c", 2), ("a", 1), ("b", 1)]


def test_top_k_same_result_any_partitioning(spark):
    df = spark.createDataFrame([(str(i % 13),) for i in range(1000)], "k string")
    a = [tuple(r) for r in top_k(df.repartition(1), "k", 5).collect()]
    b = [tuple(r) for r in top_k(df.repartition(7), "k", 5).collect()]
    assert a == b


def test_year_trend_drops_excluded_and_null(spark):
    df = spark.createDataFrame([("01-02-2020",), ("05-06-2021",), ("13-45-2020",), ("03-03-2023",)], "date_occ string")
    got = [tuple(r) for r in year_trend(df, exclude_year=2023).collect()]
    assert got == [(2020, 1), (2021, 1)]
    assert len(year_trend(df).collect()) == 4     # no filter: NULL year is a group


def test_month_trend_half_open(spark):
    df = spark.createDataFrame([("01-01-2020",), ("12-31-2022",), ("01-01-2023",), ("03-15-2021",)], "date_occ string")
    got = {tuple(r) for r in month_trend(df, "2020-01-01", "2023-01-01").collect()}
    assert got == {(1, 1), (12, 1), (3, 1)}


def test_weekday_trend_calendar_order(spark):
    # 2024-01-01 is a Monday; one row per day for two weeks plus an invalid date
    dates = [f"01-{d:02d}-2024" for d in range(1, 15)] + ["13-45-2024"]
    df = spark.createDataFrame([(d,) for d in dates], "date_occ string")
    got = [tuple(r) for r in weekday_trend(df, weekday_dim(spark)).collect()]
    assert [d for d, _ in got] == WEEKDAYS and all(n == 2 for _, n in got)


def test_area_filtered_vs_wide(spark):
    rows = [("A", "Black"), ("A", "White"), ("B", "White"), ("C", "Other")]
    df = spark.createDataFrame(rows, "area_name string, vict_descent string")
    assert {tuple(r) for r in by_area(df, "Black").collect()} == {("A", 1)}
    wide = {r.area_name: (r.n_black, r.n_white) for r in area_by_group_wide(df, ["Black", "White"]).collect()}
    assert wide == {"A": (1, 1), "B": (0, 1), "C": (0, 0)}
    assert count_by(df, "area_name").count() == 3
