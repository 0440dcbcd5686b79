"""Plan properties that matter at scale, asserted on the physical plans (regression guard)."""
import pytest

from blotter.operators import recode
from blotter.operators.trends import month_trend, top_k, year_trend
from blotter.plans.cleaning import clean_incidents
from blotter.session import shared_dir
from blotter.sources import layer
from blotter.sources.standin import raw_incidents, standin_recode_dim


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def env(spark, sf):
    raw_path = shared_dir(spark, "plan-raw")
    layer.write_raw_layer(raw_incidents(spark, sf), raw_path)
    raw = layer.read_layer(spark, raw_path)
    dim = recode.check_dim(standin_recode_dim(spark, sf))
    cleaned = clean_incidents(raw, dim)
    layer_path = shared_dir(spark, "plan-layer")
    layer.write_layer(cleaned, layer_path)
    return raw, cleaned, layer.read_layer(spark, layer_path)


def test_cleaning_is_one_narrow_stage(env):
    _, cleaned, _ = env
    p = plan(cleaned)
    assert "Exchange hashpartitioning" not in p and "SortMergeJoin" not in p
    assert p.count("BroadcastHashJoin") == 5


def test_layer_write_is_rebalanced_not_repartitioned(env):
    _, cleaned, _ = env
    p = plan(layer.with_partition_year(cleaned).hint("rebalance", layer.PARTITION_COLUMN))
    assert "REBALANCE_PARTITIONS_BY_COL" in p


def test_top_k_is_per_task_top_k_over_one_column(env):
    _, _, clean = env
    p = plan(top_k(clean, "crm_cd_desc"))
    assert "TakeOrderedAndProject" in p and "partial_count" in p
    assert "ReadSchema: struct<crm_cd_desc:string>" in p


def test_month_trend_prunes_years_and_pushes_dates(env):
    _, _, clean = env
    p = plan(month_trend(clean, "1995-01-01", "1998-01-01"))
    assert "PartitionFilters: [isnotnull(occ_year" in p
    assert "GreaterThanOrEqual(occ_date" in p and "LessThan(occ_date" in p
    assert "rangepartitioning" not in p


def test_year_trend_reads_no_data_column(env):
    _, _, clean = env
    p = plan(year_trend(clean, exclude_year=2001))
    assert "ReadSchema: struct<>" in p


def test_forest_scores_once_and_reads_raw_once(env, spark):
    from blotter.operators.classify import row_key
    from blotter.plans.classification import train_classifier
    raw, _, _ = env
    raw_files = set(raw.inputFiles())
    c = train_classifier(raw, row_key("dr_no"), num_trees=2)
    for out in (c.scored, c.test, c.accuracy(), c.confusion(), c.predictions(), c.skipped()):
        assert not raw_files & set(out.inputFiles())         # every output reads the written tables
    for out in (c.accuracy(), c.confusion(), c.predictions()):
        assert plan(out).count("FileScan parquet") == 1      # one scan of the scored rows, no model in it
    for unused in ("date_rptd", "mocodes", "cross_street", "crm_cd_3", "lat"):
        assert unused not in c.test.columns


def test_value_counts_one_scan(env):
    from blotter.operators.profile import ValueCounts
    raw, _, _ = env
    vc = ValueCounts(raw, ["crm_cd_desc", "premis_desc", "vict_sex"])
    p = plan(vc.table)
    assert p.count("FileScan parquet") == 1 and "Generate explode" in p
    vc.release()
