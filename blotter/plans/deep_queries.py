"""Registered queries of the operators beyond the analysis itself: exact indexes, quarantine, incremental report,
permutation importance, condensed itemsets, repairs, exact splits, ranking quality, clustered layer, heavy hitters.

Same conventions as :mod:`blotter.plans.queries`; the SQL is in :mod:`blotter.plans.deep_oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.operators import classify, evaluate, heavy, itemsets, patterns, repair, recode
from blotter.operators.index import ExactIndex
from blotter.plans import queries as base
from blotter.plans.cleaning import RECODE_DOMAINS
from blotter.schema import RAW_COLUMNS
from blotter.session import shared_dir, stored
from blotter.sources import layer, zlayer
from blotter.sources.csv import has_folder, land_parts, move_folder, read_raw_csv, write_csv
from blotter.sources.quarantine import split_csv
from blotter.sources.standin import in_turns, raw_incidents

#: Inputs whose values are permuted for their importance.
SCORER_INPUT, OTHER_INPUT = "premis_desc", "vict_sex"
POSITIVE = "Invest Cont"
AREA, DATES = "NATION_3", ("1995-01-01", "1995-07-01")


def q_index_any(spark: SparkSession, sf: str) -> DataFrame:
    """The five categories, the address included, indexed without labels on the driver and joined back to the rows."""
    rows = base.raw(spark, sf).select(*classify.CATEGORICAL)
    index = ExactIndex(rows, classify.CATEGORICAL)
    out = None
    for c in classify.CATEGORICAL:
        one = index.transform(rows.select(c), c, "index")
        one = one.groupBy(F.lit(c).alias("input"), F.col(c).alias("value"), "index", index.slot(c, "index").alias("slot")) \
            .agg(F.count(F.lit(1)).alias("count"))
        out = one if out is None else out.unionByName(one)
    return out


def _with_bad_lines(spark: SparkSession, sf: str) -> str:
    """The raw file with some of its lines broken, by the codes of the row: cut after 5 fields, 2 fields more, a quote left open, emptied."""
    raw = raw_incidents(spark, sf, normalize=False)
    path = shared_dir(spark, "broken-csv")
    lines = raw.select(F.to_csv(F.struct(*(F.col(c) for c in RAW_COLUMNS))).alias("line"), (F.col("Mocodes").cast("long") % 50).alias("kind"))
    broken = (F.when(F.col("kind") == 1, F.substring_index("line", ",", 5)).when(F.col("kind") == 2, F.concat("line", F.lit(",x,y")))
              .when(F.col("kind") == 3, F.concat("line", F.lit('"'))).when(F.col("kind") == 4, F.lit("  ")).otherwise(F.col("line")))
    header = F.lit(",".join(RAW_COLUMNS))
    # each file begins with the header: one line more at the head of every partition
    parts = lines.select(broken.alias("value")).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = parts.select(F.explode(F.when(F.col("at") == 0, F.array(header, F.col("value"))).otherwise(F.array("value"))).alias("value"))
    rows.write.text(path)
    return path


def q_csv_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each outcome, and what they hold: rows by area, rejected lines by reason and number of fields."""
    split = split_csv(spark, _with_bad_lines(spark, sf))
    rows = split.rows().groupBy(F.lit("clean").alias("outcome"), F.col("area_name").alias("detail"), F.lit(28).alias("fields")) \
        .agg(F.count(F.lit(1)).alias("lines"))
    bad = split.rejected().groupBy(F.lit("rejected").alias("outcome"), F.col("reason").alias("detail"), "fields").agg(F.count(F.lit(1)).alias("lines"))
    return rows.unionByName(bad)


def q_incremental_report(spark: SparkSession, sf: str) -> DataFrame:
    """The raw file lands in three parts, the third one after the state has been compacted; a batch is folded twice."""
    from blotter.streaming.report import start_report
    arriving, landing, state_dir, ckpt = (shared_dir(spark, n) for n in ("report-arriving", "report-landing", "report-state", "report-ckpt"))
    raw = raw_incidents(spark, sf, normalize=False)
    third = F.pmod(F.coalesce(classify.row_key("DR_NO"), F.lit(0)), F.lit(3))
    dim = recode.check_dim(base.dim(spark, sf))
    for share in in_turns(raw, sf):
        land_parts(share, arriving, third)
    state = None
    for part in range(3):
        if has_folder(spark, f"{arriving}/part={part}"):    # a part without rows has no folder
            move_folder(spark, f"{arriving}/part={part}", f"{landing}/part={part}")
        else:
            write_csv(raw.limit(0), f"{landing}/part={part}")
        query, state = start_report(spark, landing, state_dir, ckpt, dim)
        if not query.awaitTermination(1800):
            query.stop()
            raise TimeoutError("the report did not finish within 30 minutes")
        if query.exception():
            raise query.exception()
        if part == 1:
            state.compact(keep=1)
            newest = int(state.folders()[1][-1].rsplit("=", 1)[1])
            from blotter.plans.cleaning import clean_incidents
            from blotter.streaming.report import with_calendar
            again = clean_incidents(read_raw_csv(spark, f"{landing}/part={part}"), dim)
            state.fold(with_calendar(layer.with_partition_year(again)), newest)
    tables = state.report(base.MONTH_RANGE, exclude_year=base.EXCLUDED_YEAR)
    out = None
    for name in ("top_crime", "count_by_sex", "age_sex_dist", "year_trend", "month_trend", "weekday_trend", "count_by_area_hispanic"):
        df = tables[name]
        keys = [c for c in df.columns if c not in ("count", "crime_count")]
        one = df.select(F.lit(name).alias("report"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in keys)).alias("key"),
                        F.col(df.columns[-1]).alias("count"))
        out = one if out is None else out.unionByName(one)
    return out


def _scorer(spark: SparkSession, sf: str):
    """(test rows, key, predict): the majority-class scorer of the premise, fitted on the training rows."""
    rows = stored(base.raw(spark, sf).select("dr_no", SCORER_INPUT, OTHER_INPUT, classify.LABEL_SOURCE), "scorer-rows")
    train, test = classify.key_split(rows, classify.row_key("dr_no"), base.TRAIN_PERCENT)
    return test, F.coalesce("dr_no", F.lit("")), lambda df: classify.baseline(train, df, SCORER_INPUT)


def q_permutation_importance(spark, sf):
    test, key, predict = _scorer(spark, sf)
    out = evaluate.permutation_importance(test, predict, [SCORER_INPUT, OTHER_INPUT], key)
    return out.withColumn("importance", F.round("importance", 6))


def _scored(spark, sf) -> DataFrame:
    """Test rows with the share of the positive label among the training rows of their premise."""
    rows = base.raw(spark, sf).select("dr_no", SCORER_INPUT, classify.LABEL_SOURCE).filter(f"{SCORER_INPUT} is not null")
    train, test = classify.key_split(rows, classify.row_key("dr_no"), base.TRAIN_PERCENT)
    share = train.groupBy(SCORER_INPUT).agg((F.count_if(F.col(classify.LABEL_SOURCE) == POSITIVE) / F.count(F.lit(1))).alias("score"))
    return test.join(share, SCORER_INPUT).select("dr_no", "score", (F.col(classify.LABEL_SOURCE) == POSITIVE).alias("positive"))


def q_auc(spark, sf):
    return evaluate.auc(_scored(spark, sf)).select("positives", "negatives", F.col("twice_u").cast("double").alias("twice_u"), F.round("auc", 6).alias("auc"))


def q_calibration(spark, sf):
    out = evaluate.calibration(_scored(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "positive_share")})


def q_condensed_itemsets(spark, sf):
    found = itemsets.condensed(base.event_rule_model(spark, sf).freqItemsets)
    return found.select(patterns.items_text("items").alias("items"), "freq", "above", "closed", "maximal")


def q_significant_rules(spark, sf):
    train, _ = classify.key_split(base.event_baskets(spark, sf), "event_id", base.TRAIN_PERCENT)
    rules = itemsets.significant_rules(base.event_rule_model(spark, sf).freqItemsets, train.count(), base.MIN_CONFIDENCE)
    text = lambda c: patterns.items_text(c).alias(c)
    return rules.select(text("antecedent"), text("consequent"), "n_both", "n_antecedent", "n_consequent", F.round("confidence", 6).alias("confidence"),
                        F.round("chi2", 3).alias("chi2"), "significant")


def q_rule_predict_any(spark, sf):
    """The rules' answers through the join that needs no rule on the driver or in a broadcast."""
    _, test = classify.key_split(base.event_baskets(spark, sf), "event_id", base.TRAIN_PERCENT)
    out = itemsets.predict(base.event_rule_model(spark, sf).associationRules, test, broadcast_rules=0)
    return out.select("event_id", patterns.items_text("items").alias("items"), patterns.items_text("prediction").alias("prediction"))


def q_repair_suggestions(spark, sf):
    dim = base.dim(spark, sf)
    unmapped = recode.coverage_many(base.raw(spark, sf), recode.merge_passes(dim, "premise", "premise_pass2"), RECODE_DOMAINS)
    keys = dim.select(F.when(F.col("domain") == "premise_pass2", "premise").otherwise(F.col("domain")).alias("domain"), "raw").distinct()
    return repair.suggestions(unmapped, keys)


def q_stratified_split(spark, sf):
    rows = base.raw(spark, sf)
    key = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in rows.columns))    # some incident numbers come twice
    out = evaluate.stratified_flag(rows, "status_desc", key, base.TRAIN_PERCENT)
    return out.select("dr_no", "status_desc", "in_train")


def q_top_location(spark, sf):
    return heavy.top_values(base.raw(spark, sf), "location", base.TOP_K)


def q_clustered_area_dates(spark, sf):
    """Crimes of one area in half a year, read from the files of the clustered layer that may hold them."""
    rows = layer.with_partition_year(base.clean(spark, sf)).select("area_name", "crm_cd_desc", F.col(layer.DATE_COLUMN).cast("string").alias("day"))
    path = shared_dir(spark, "clustered")
    zlayer.write_clustered(rows, path, ["day", "area_name", "crm_cd_desc"], files=64)
    found = zlayer.Clustered(spark, path, rows.schema).read(area_name=AREA, day=DATES)
    return found.groupBy("area_name", "crm_cd_desc").agg(F.count(F.lit(1)).alias("count"))


DEEP_QUERIES = {
    "index_any": q_index_any,
    "csv_quarantine": q_csv_quarantine,
    "incremental_report": q_incremental_report,
    "permutation_importance": q_permutation_importance,
    "condensed_itemsets": q_condensed_itemsets,
    "significant_rules": q_significant_rules,
    "rule_predict_any": q_rule_predict_any,
    "repair_suggestions": q_repair_suggestions,
    "stratified_split": q_stratified_split,
    "auc": q_auc,
    "calibration": q_calibration,
    "clustered_area_dates": q_clustered_area_dates,
    "top_location": q_top_location,
}
