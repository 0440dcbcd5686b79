"""Print the physical plans of the bench flows (scan / exchange / join / top-k lines).

Usage: python tools/show_plans.py [sf_dir] > PLANS.md
Builds the raw CSV and the clean layer like bench.py, then shows, per query,
the operators that matter at scale: file scans with their pushed and
partition filters and read schema, exchanges, broadcasts, joins, top-k.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from blotter.operators import profile, recode  # noqa: E402
from blotter.plans.cleaning import RECODE_DOMAINS, clean_incidents  # noqa: E402
from blotter.plans.eda import eda_report  # noqa: E402
from blotter.plans.rules import incident_baskets  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from blotter.plans.queries import EXCLUDED_YEAR, MONTH_RANGE  # noqa: E402
from blotter.session import local_session, shared_dir  # noqa: E402
from blotter.sources import layer  # noqa: E402
from blotter.sources.csv import read_raw_csv, write_csv  # noqa: E402
from blotter.sources.standin import raw_incidents, standin_recode_dim  # noqa: E402

KEEP = ("Scan", "Exchange", "BroadcastHashJoin", "SortMergeJoin", "TakeOrderedAndProject",
        "HashAggregate", "Coalesce", "Expand", "Generate")


def summary(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        if any(k in line for k in KEEP):
            line = re.sub(r"Location: [^,]*, ", "", line)
            line = re.sub(r"#\d+L?", "", line)
            out.append(line.rstrip()[:420])
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 16, max_partition_mb=16)
    csv_path = shared_dir(spark, "plans-raw-csv")
    write_csv(raw_incidents(spark, sf_dir, normalize=False), csv_path)
    raw_path = shared_dir(spark, "plans-raw-layer")
    layer.write_raw_layer(read_raw_csv(spark, csv_path), raw_path)
    raw = layer.read_layer(spark, raw_path)      # as the bench: the CSV is parsed once
    dim = recode.merge_passes(recode.check_dim(standin_recode_dim(spark, sf_dir)), "premise", "premise_pass2")
    cleaned = clean_incidents(raw, dim, second_passes={})
    layer_path = shared_dir(spark, "plans-layer")
    layer.write_layer(cleaned, layer_path)
    clean = layer.read_layer(spark, layer_path)
    plans = {
        "clean (raw layer -> cleaned rows, before the layer write)": cleaned,
        "layer write input (REBALANCE by year)": layer.with_partition_year(cleaned).hint("rebalance", "occ_year"),
        "null_profile (raw layer)": profile.null_profile(raw),
        "distinct_values as its own query (raw layer, four columns, one pass)": profile.distinct_values_many(
            raw, ["crm_cd_desc", "premis_desc", "weapon_desc", "status_desc"]),
        "recode_unmapped as its own query (raw layer, five domains, one pass)":
            recode.coverage_many(raw, dim, RECODE_DOMAINS),
    }
    vc = profile.ValueCounts(raw, ["crm_cd_desc", "premis_desc", "weapon_desc", "status_desc", *RECODE_DOMAINS])
    plans["value counts for distinct + unmapped values (raw, one pass, persisted)"] = vc.table
    plans["incident baskets (layer)"] = incident_baskets(
        clean, F.xxhash64("date_occ", "time_occ", "location", "crm_cd_desc").alias("k"))
    from blotter.operators import classify
    feats = classify.typed_features(raw).select("dr_no", "location", "status_desc", "vict_age")
    train, (test,) = classify.frequency_encode(feats.filter("dr_no is not null"), [feats], "location",
                                               "location_freq", n_values=20_000)
    plans["frequency-encoded address for the forest (raw, size-checked broadcast of counts)"] = test
    for name, df in eda_report(spark, clean, MONTH_RANGE, exclude_year=EXCLUDED_YEAR, single_pass=True).items():
        how = ("own scan" if name in ("year_trend", "month_trend")
               else "from the report's one GROUPING SETS pass")
        plans[f"{name} (layer, {how})"] = df
    plans["top_crime as its own query (layer)"] = eda_report(
        spark, clean, MONTH_RANGE, exclude_year=EXCLUDED_YEAR)["top_crime"]
    print(f"# Physical plans at {sf_dir}\n")
    print("Generated by `python tools/show_plans.py`; adaptive plans before execution, "
          "expression ids removed.\n")
    for name, df in plans.items():
        print(f"## {name}\n\n```")
        print("\n".join(summary(df)))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
