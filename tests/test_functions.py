import datetime as dt

from pyspark.sql import functions as F

from blotter.functions import date_text, day_name, month_name, parse_date, time_text, to_double, to_int


def _one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def test_date_text_good_and_bad(spark):
    assert _one(spark, date_text, "03/01/2020 12:00:00 AM") == "03-01-2020"
    assert _one(spark, date_text, "13/45/2020 12:00:00 AM") == "13-45-2020"
    assert _one(spark, date_text, None) is None


def test_parse_date_and_names(spark):
    d = lambda c: parse_date(date_text(c))
    assert _one(spark, d, "03/01/2020 12:00:00 AM") == dt.date(2020, 3, 1)
    assert _one(spark, lambda c: month_name(d(c)), "03/01/2020 12:00:00 AM") == "March"
    assert _one(spark, lambda c: day_name(d(c)), "03/01/2020 12:00:00 AM") == "Sunday"
    # invalid day/month: NULL date and names, no error under ANSI mode
    assert _one(spark, d, "13/45/2020 12:00:00 AM") is None
    assert _one(spark, lambda c: month_name(d(c)), "13/45/2020 12:00:00 AM") is None


def test_time_text(spark):
    cases = {"45": "00:45", "1": "00:01", "2130": "21:30", "12345": "12:34", "0": "00:00"}
    for raw, want in cases.items():
        assert _one(spark, time_text, raw) == want
    assert _one(spark, time_text, None) is None


def test_safe_casts(spark):
    assert _one(spark, to_int, "x") is None
    assert _one(spark, to_int, "") is None
    assert _one(spark, to_int, "-3") == -3
    assert _one(spark, to_int, "99999999999") is None
    assert _one(spark, to_double, "33.9550") == 33.955
    assert _one(spark, to_double, "n/a") is None
