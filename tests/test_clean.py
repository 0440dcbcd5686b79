from blotter.operators.clean import filter_counts, filter_placeholders, filter_valid
from blotter.operators.profile import distinct_values_many, null_profile, null_profile_long, preview, row_count
from blotter.schema import RAW_COLUMNS, snake
from blotter.session import shared_dir
from blotter.sources.csv import read_raw_csv

COLS = "vict_age int, vict_sex string, vict_descent string, premis_desc string, weapon_desc string"


def _rows(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_age_rules(spark):
    base = ("Male", "Black", "Street", "Knife")
    df = _rows(spark, [(a, *base) for a in (-3, -2, -1, 0, 25, None)])
    kept = sorted(r.vict_age for r in filter_valid(df).collect())
    assert kept == [-3, 25]          # sentinels and NULL dropped, -3 kept


def test_sex_descent_premise_weapon_rules(spark):
    rows = [
        (30, "Unknown", "Black", "Street", "Knife"),   # X recoded to Unknown: kept
        (30, "H", "Black", "Street", "Knife"),         # dropped
        (30, None, "Black", "Street", "Knife"),        # NULL sex: dropped
        (30, "null", "Black", "Street", "Knife"),      # text null: dropped
        (30, "Male", None, "Street", "Knife"),         # NULL descent: dropped
        (30, "Male", "-", "Street", "Knife"),          # unmapped descent: kept
        (30, "Male", "Black", "Unknown", "Knife"),     # premise text null recoded: kept
        (30, "Male", "Black", None, "Knife"),          # NULL premise: dropped
        (30, "Male", "Black", "Street", None),         # NULL weapon: dropped
        (30, "Male", "Black", "Street", "null"),       # text null weapon: dropped
    ]
    out = filter_valid(_rows(spark, rows)).collect()
    assert len(out) == 3
    counts = filter_counts(_rows(spark, rows)).first()
    assert counts["kept"] == 3 and counts["bad_sex"] == 3 and counts["bad_weapon"] == 2


def test_placeholders(spark):
    cols = ["a", "b"]
    df = spark.createDataFrame([("x", "y"), ("Unknown", "y"), ("x", "Other"), ("Other Asian", "y"), (None, "y")],
                               "a string, b string")
    kept = sorted(tuple(r) for r in filter_placeholders(df, cols).collect())
    assert kept == [("Other Asian", "y"), ("x", "y")]


def test_csv_edge_empty_and_null_text(spark):
    path = shared_dir(spark, "csv-test")
    header = ",".join(f'"{c}"' for c in RAW_COLUMNS)
    line1 = ",".join(["1", "", "null"] + ["v"] * (len(RAW_COLUMNS) - 3))
    spark.createDataFrame([(header,), (line1,)], "value string").coalesce(1).write.text(path)
    df = read_raw_csv(spark, path)
    r = df.first()
    assert df.columns == [snake(c) for c in RAW_COLUMNS]
    assert r["date_rptd"] is None          # empty field -> NULL
    assert r["date_occ"] == "null"         # text null stays text
    assert dict(df.dtypes)["vict_age"] == "string"


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (3, "a")], "x int, y string")
    assert null_profile(df).first().asDict() == {"x": 1, "y": 1}
    assert {tuple(r) for r in null_profile_long(df).collect()} == {("x", 1), ("y", 1)}
    assert row_count(df).first()["row_count"] == 3
    assert [r.x for r in preview(df, ["x"], 2).collect()] == [None, 1]
    dv = {tuple(r) for r in distinct_values_many(df, ["x", "y"]).collect()}
    assert dv == {("x", "1"), ("x", None), ("x", "3"), ("y", None), ("y", "a")}


def test_clean_schema(spark, sf):
    from blotter.plans.queries import clean
    from blotter.schema import CLEAN_SCHEMA
    df = clean(spark, sf)
    assert [(f.name, f.dataType) for f in df.schema.fields] == \
           [(f.name, f.dataType) for f in CLEAN_SCHEMA.fields]


def test_cluster_conf_scales_with_input():
    from blotter.session import cluster_conf
    small = cluster_conf(10 * 1024 ** 3, total_cores=64)
    big = cluster_conf(100 * 1024 ** 4, total_cores=8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 128
    assert int(big["spark.sql.shuffle.partitions"]) == 50_000
    assert big["spark.sql.adaptive.enabled"] == "true"
