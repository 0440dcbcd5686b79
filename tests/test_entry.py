"""Driver contract and SQL-oracle agreement at sf0.001."""
import json

import duckdb
import pytest

import __spark_entry__ as entry_mod
from blotter.plans.queries import QUERIES
from tools.check_oracle import TABLES, digest

FAST = ["row_count", "null_profile", "distinct_values", "recode_premise", "recode_unmapped", "top_crime",
        "top_weapon", "weekday_trend", "year_trend", "month_trend", "area_by_group_wide", "basket_build",
        "freq_itemsets", "assoc_rules", "rule_predict", "string_index", "one_hot", "key_split", "parse_date",
        "clean_stream_roundtrip", "incident_itemsets", "incident_rules", "csv_roundtrip"]


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert df.columns == ["crm_cd_desc", "count"] and 0 < len(rows) <= 10


def test_every_query_has_an_oracle_or_is_ml():
    qs, sqls = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sqls) <= set(qs)
    ours = {q for q in qs if q in QUERIES}
    assert ours - set(sqls) == {"rf_predict", "rf_accuracy", "confusion", "rf_importance",
                                   "rf_onehot_accuracy", "rf_onehot_importance"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, sf, con, name):
    df = entry_mod.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry_mod.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows), json.dumps(rows[:3], default=str)


def test_forest_queries_run(spark, sf):
    q = entry_mod.queries()
    acc = q["rf_accuracy"](spark, sf).first()
    conf = q["confusion"](spark, sf).collect()
    assert sum(r["count"] for r in conf) == acc.scored
    imp = q["rf_importance"](spark, sf).collect()
    assert len(imp) == 9 and abs(sum(r.importance for r in imp) - 1) < 1e-9
    assert acc.accuracy > q["baseline_accuracy"](spark, sf).first().accuracy - 0.02


def test_changed_files_are_fitted_anew(spark, sf, tmp_path):
    import os
    import shutil

    from blotter.plans import queries
    for name in queries.MODEL_TABLES:
        shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    built = []
    get = lambda: queries._memo("state-test", spark, str(tmp_path), lambda: built.append(1) or len(built))
    assert (get(), get()) == (1, 1)
    path = tmp_path / "orders.parquet"
    os.utime(path, (path.stat().st_atime, path.stat().st_mtime + 60))
    assert (get(), get()) == (2, 2)
