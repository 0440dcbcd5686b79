"""The whole incident analysis as one batch job: raw CSV + dictionary CSV -> result tables.

    python -m blotter.plans.job --raw <csv dir> --dictionary <csv> --out <dir>
        [--month-range 2020-01-01 2023-01-01] [--exclude-year 2023]
        [--min-support 0.2] [--min-confidence 0.5] [--location-encoding frequency]

Steps (each result is written as Parquet below ``--out``; nothing is
collected except small summaries printed at the end):

1. split the raw CSV into rows (``raw/``, all text) and malformed lines (``quarantine/lines`` with file and
   reason, ``quarantine/counts``), profile the rows:
   ``profile/nulls``, ``profile/distinct``, ``profile/unmapped``, ``profile/filter_counts``;
2. clean into ``clean/`` (partitioned by ``occ_year``);
3. the exploratory report: ``report/<name>`` for every table behind the charts;
4. association rules: ``rules/itemsets``, ``rules/rules``, ``rules/predictions``;
5. the classifier: ``forest/predictions``, ``forest/confusion``, ``forest/accuracy``,
   ``forest/skipped`` (held-out rows with a NULL numeric input), ``forest/importances``.

The dictionary CSV has a header ``domain,raw,target`` with domains ``sex``,
``descent``, ``crime``, ``premise`` (and optionally ``premise_pass2``), ``weapon``.
"""

from __future__ import annotations

import argparse
import json

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.operators import classify, profile, recode
from blotter.operators.clean import filter_counts
from blotter.plans.classification import train_classifier
from blotter.plans.cleaning import RECODE_DOMAINS, clean_incidents, recoded_incidents
from blotter.plans.eda import eda_report
from blotter.plans.rules import incident_baskets, mine_rules
from blotter.sources import layer
from blotter.session import size_to_input
from blotter.sources.csv import read_raw_csv
from blotter.sources.quarantine import split_csv


DISTINCT_COLUMNS = ["crm_cd_desc", "premis_desc", "weapon_desc", "status_desc"]


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A header in another order or with other names fails, as for the incident files."""
    return read_raw_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in ("domain", "raw", "target")]), normalize=False)


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def run(spark: SparkSession, raw_csv: str, dictionary: DataFrame, out: str,
        month_range: tuple[str, str], exclude_year: int | None,
        min_support: float = 0.2, min_confidence: float = 0.5,
        location_encoding: str = "hashed") -> dict:
    out = out.rstrip("/")
    split = split_csv(spark, raw_csv)
    layer.write_raw_layer(split.rows(), f"{out}/raw")
    _write(split.rejected(), f"{out}/quarantine/lines")
    _write(split.counts(), f"{out}/quarantine/counts")
    raw = layer.read_layer(spark, f"{out}/raw")
    dim = recode.check_dim(dictionary)
    if dim.has("premise_pass2"):
        dim = recode.merge_passes(dim, "premise", "premise_pass2")
    passes: dict[str, str] = {}

    _write(profile.null_profile(raw), f"{out}/profile/nulls")
    vc = profile.ValueCounts(raw, DISTINCT_COLUMNS + list(RECODE_DOMAINS))   # one pass for both
    _write(vc.distinct_values(DISTINCT_COLUMNS), f"{out}/profile/distinct")
    _write(recode.coverage_from_counts(vc.table, dim, RECODE_DOMAINS), f"{out}/profile/unmapped")
    vc.release()
    _write(filter_counts(recoded_incidents(raw, dim, passes)), f"{out}/profile/filter_counts")

    layer.write_layer(clean_incidents(raw, dim, passes, keep=("dr_no",)), f"{out}/clean")
    clean = layer.read_layer(spark, f"{out}/clean")

    report = eda_report(spark, clean, month_range, exclude_year=exclude_year, single_pass=True)
    for name, df in report.items():
        _write(df, f"{out}/report/{name}")
    report.release()

    key = classify.row_key("dr_no")
    baskets = incident_baskets(clean.withColumn("dr_no", key), "dr_no")
    rm = mine_rules(baskets, "dr_no", min_support, min_confidence)
    _write(rm.itemsets(), f"{out}/rules/itemsets")
    _write(rm.rules(), f"{out}/rules/rules")
    _write(rm.predictions().select("dr_no", F.array_join(F.array_sort("items"), ",").alias("items"),
                                   F.array_join(F.array_sort("prediction"), ",").alias("prediction")),
           f"{out}/rules/predictions")
    rm.release()

    forest = train_classifier(raw, key, location_encoding=location_encoding)
    _write(forest.predictions(), f"{out}/forest/predictions")
    _write(forest.confusion(), f"{out}/forest/confusion")
    _write(forest.accuracy(), f"{out}/forest/accuracy")
    _write(forest.skipped(), f"{out}/forest/skipped")
    spark.createDataFrame(forest.importances(), "feature string, importance double") \
         .write.mode("overwrite").parquet(f"{out}/forest/importances")

    acc = spark.read.parquet(f"{out}/forest/accuracy").first()
    return {"accuracy": acc.accuracy, "scored": acc.scored,
            "itemsets": spark.read.parquet(f"{out}/rules/itemsets").count(),
            "rules": spark.read.parquet(f"{out}/rules/rules").count()}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--raw", required=True)
    ap.add_argument("--dictionary", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--month-range", nargs=2, default=["2020-01-01", "2023-01-01"])
    ap.add_argument("--exclude-year", type=int, default=None)
    ap.add_argument("--min-support", type=float, default=0.2)
    ap.add_argument("--min-confidence", type=float, default=0.5)
    ap.add_argument("--location-encoding", default="hashed", choices=["hashed", "frequency", "onehot"])
    ap.add_argument("--no-size-to-input", action="store_true",
                    help="keep the session's split and shuffle settings instead of sizing them to the input")
    a = ap.parse_args(argv)
    builder = SparkSession.builder.appName("blotter-job")
    if not SparkConf().contains("spark.master"):     # plain `python -m`: run locally
        builder = builder.master("local[*]")
    spark = builder.getOrCreate()
    if not a.no_size_to_input:
        size_to_input(spark, a.raw)
    summary = run(spark, a.raw, read_dictionary(spark, a.dictionary), a.out, tuple(a.month_range),
                  a.exclude_year, a.min_support, a.min_confidence, a.location_encoding)
    print(json.dumps(summary))


if __name__ == "__main__":
    main()
