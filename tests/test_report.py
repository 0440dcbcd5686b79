"""The one-pass report equals the per-table report, table by table."""
from blotter.plans.eda import eda_report
from blotter.plans.queries import EXCLUDED_YEAR, MONTH_RANGE, clean


def test_single_pass_report_equals_separate_queries(spark, sf):
    df = clean(spark, sf).cache()
    separate = eda_report(spark, df, MONTH_RANGE, exclude_year=EXCLUDED_YEAR)
    one_pass = eda_report(spark, df, MONTH_RANGE, exclude_year=EXCLUDED_YEAR, single_pass=True)
    assert set(separate) == set(one_pass)
    for name in separate:
        a, b = separate[name], one_pass[name]
        assert a.columns == b.columns, name
        assert dict(a.dtypes) == dict(b.dtypes), name
        assert [tuple(r) for r in a.collect()] == [tuple(r) for r in b.collect()] or \
            sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str), name
    df.unpersist()


def test_groups_that_begin_alike_have_tables_of_their_own():
    from blotter.plans.eda import area_names
    assert area_names(["Hispanic/Latin", "Black", "Other Asian", "Other"]) == {
        "Hispanic/Latin": "count_by_area_hispanic", "Black": "count_by_area_black",
        "Other Asian": "count_by_area_other_asian", "Other": "count_by_area_other"}
