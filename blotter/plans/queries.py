"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the test tables (through the stand-in incident table of
:mod:`blotter.sources.standin`) over their whole extent; output columns carry
explicit names shared with the SQL oracle in :mod:`blotter.plans.oracle`.
Outputs hold no DATE values (dates as ISO text), so value hashing agrees
however each side converts dates.  Queries that read one fitted model (the
three rule-mining queries per basket, the forest queries) share one fit per
session and scale (``_memo``); each still works when called alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.fpm import FPGrowthModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.functions import date_text, day_name, month_name, month_number, parse_date, time_text, to_double, to_int
from blotter.operators import classify, patterns, profile, recode, trends
from blotter.operators.clean import (
    drop_columns,
    filter_counts,
    filter_placeholders,
    not_in,
)
from blotter.plans.cleaning import RECODE_DOMAINS, clean_incidents, recoded_incidents, typed_incidents
from blotter.schema import BASKET_COLUMNS, CLEAN_COLUMNS, RAW
from blotter.plans.classification import train_classifier
from blotter.plans.rules import incident_baskets, mine_rules
from blotter.session import shared_dir, stored
from blotter.sources import layer
from blotter.sources.csv import land_parts, read_raw_csv, write_csv
from blotter.sources.dims import weekday_dim
from blotter.sources.standin import (
    EVENT_ITEM_COLUMNS,
    events_basket_columns,
    in_turns,
    raw_incidents,
    standin_recode_dim,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the stand-in analyses (the reference's values where they carry over).
EXCLUDED_YEAR = 2001                      # last, incomplete year of the stand-in dates
MONTH_RANGE = ("1995-01-01", "1998-01-01")
GROUPS = ["Hispanic/Latin", "Black", "White"]
MIN_SUPPORT, MIN_CONFIDENCE = 0.1, 0.5    # events basket (independent incident columns give no rules)
TRAIN_PERCENT = 80
TOP_K = 10


# --- building blocks ----------------------------------------------------------
def raw(spark: SparkSession, sf: str) -> DataFrame:
    return raw_incidents(spark, sf)


def dim(spark: SparkSession, sf: str) -> DataFrame:
    return standin_recode_dim(spark, sf)


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return clean_incidents(raw(spark, sf), dim(spark, sf))


def recoded(spark: SparkSession, sf: str) -> DataFrame:
    return recoded_incidents(raw(spark, sf), dim(spark, sf))


# --- sources / sinks ----------------------------------------------------------
def q_csv_roundtrip(spark, sf):
    path = shared_dir(spark, "raw-csv")
    for share in in_turns(raw_incidents(spark, sf, normalize=False), sf):
        write_csv(share, path, mode="append", packed=True)
    return read_raw_csv(spark, path)


def _layer_contract(df: DataFrame) -> DataFrame:
    """The cleaned columns plus the year folder (the layer's typed date copy is internal)."""
    return df.select(*CLEAN_COLUMNS, layer.PARTITION_COLUMN)


def q_clean_sink_roundtrip(spark, sf):
    path = shared_dir(spark, "clean-layer")
    layer.write_layer(clean(spark, sf), path)
    return _layer_contract(layer.read_layer(spark, path))


def q_clean_stream_roundtrip(spark, sf):
    """The raw file lands in two parts; the streaming ingest cleans both into a layer."""
    from blotter.streaming.ingest import start_ingest
    src = shared_dir(spark, "landing")
    raw_text = raw_incidents(spark, sf, normalize=False)
    flag = classify.split_flag(classify.row_key("DR_NO"), 50)
    for share in in_turns(raw_text, sf):
        land_parts(share, src, F.when(flag, 1).otherwise(2))
    out, ckpt = shared_dir(spark, "stream-layer"), shared_dir(spark, "stream-ckpt")
    q = start_ingest(spark, src, out, ckpt, dim(spark, sf))
    if not q.awaitTermination(1800):
        q.stop()
        raise TimeoutError("streaming ingest did not finish within 30 minutes")
    if q.exception():
        raise q.exception()
    return _layer_contract(layer.read_layer(spark, out))


def q_row_count(spark, sf):
    return profile.row_count(raw(spark, sf))


def q_preview(spark, sf):
    return profile.preview(raw(spark, sf), RAW, n=20)


# --- projections / casts --------------------------------------------------------
def q_select_cols(spark, sf):
    return clean(spark, sf).select(*BASKET_COLUMNS)


def q_drop_cols(spark, sf):
    return drop_columns(raw(spark, sf))


def q_derive_cols(spark, sf):
    d = parse_date(date_text("date_occ"))
    return raw(spark, sf).select(
        "dr_no", to_int("vict_age").alias("vict_age"), date_text("date_occ").alias("date_occ"),
        time_text("time_occ").alias("time_occ"), month_name(d).alias("month"), day_name(d).alias("day"))


def q_cast_int(spark, sf):
    return raw(spark, sf).select("dr_no", F.col("vict_age").alias("vict_age_text"),
                                 to_int("vict_age").alias("vict_age"))


def q_cast_double(spark, sf):
    return raw(spark, sf).select("dr_no", to_double("lat").alias("lat"), to_double("lon").alias("lon"))


# --- profile -----------------------------------------------------------------------
def q_null_profile(spark, sf):
    return profile.null_profile(raw(spark, sf))


def q_distinct_values(spark, sf):
    return profile.distinct_values_many(raw(spark, sf),
                                        ["crm_cd_desc", "premis_desc", "weapon_desc", "status_desc"])


# --- scalar functions --------------------------------------------------------------
def q_date_text_norm(spark, sf):
    return raw(spark, sf).select("dr_no", date_text("date_rptd").alias("date_rptd"),
                                 date_text("date_occ").alias("date_occ"))


def q_time_norm(spark, sf):
    ev = table(spark, sf, "events")
    t = (F.hour("ts") * 100 + F.minute("ts")).cast("string")
    return ev.select("event_id", t.alias("time_raw"), time_text(t).alias("time_occ"))


def q_parse_date(spark, sf):
    """Date parsed from text (NULL when invalid), shown as ISO text, with its year and month."""
    d = parse_date(date_text("date_occ"))
    return raw(spark, sf).select("dr_no", F.date_format(d, "yyyy-MM-dd").alias("occ_date"),
                                 F.year(d).alias("year"), month_number(d).alias("month"))


def q_month_day_names(spark, sf):
    d = parse_date(date_text("date_occ"))
    return raw(spark, sf).select("dr_no", month_name(d).alias("month"), day_name(d).alias("day"))


# --- filters ----------------------------------------------------------------------------
def q_filter_not_in_int(spark, sf):
    return typed_incidents(raw(spark, sf)).filter(not_in("vict_age", [-2, -1, 0])) \
        .select("vict_age", "crm_cd_desc", "date_occ")


def q_filter_not_in_str(spark, sf):
    df = recoded(spark, sf)
    keep = (not_in("vict_sex", ["null", "H"]) & not_in("vict_descent", ["null"])
            & not_in("premis_desc", ["null"]) & not_in("weapon_desc", ["null"]))
    return df.filter(keep).select("vict_sex", "vict_descent", "premis_desc", "weapon_desc")


def q_filter_rule_counts(spark, sf):
    return filter_counts(recoded(spark, sf))


def q_filter_placeholders(spark, sf):
    return filter_placeholders(clean(spark, sf).select(*BASKET_COLUMNS), BASKET_COLUMNS)


# --- recode -------------------------------------------------------------------------------
def _recode_counts(spark, sf, column, domain, second_pass=None):
    d = dim(spark, sf)
    if second_pass:
        d = recode.merge_passes(d, domain, second_pass)
    df = recode.recode(raw(spark, sf), column, d, domain, output="recoded")
    return trends.count_by(df, F.col(column).alias("raw"), "recoded")


def q_recode_sex(spark, sf):
    return _recode_counts(spark, sf, "vict_sex", "sex")


def q_recode_descent(spark, sf):
    return _recode_counts(spark, sf, "vict_descent", "descent")


def q_recode_crime(spark, sf):
    return _recode_counts(spark, sf, "crm_cd_desc", "crime")


def q_recode_premise(spark, sf):
    return _recode_counts(spark, sf, "premis_desc", "premise", second_pass="premise_pass2")


def q_recode_weapon(spark, sf):
    return _recode_counts(spark, sf, "weapon_desc", "weapon")


def q_recode_dim_profile(spark, sf):
    return recode.dim_profile(dim(spark, sf))


def q_recode_unmapped(spark, sf):
    d = recode.merge_passes(dim(spark, sf), "premise", "premise_pass2")
    return recode.coverage_many(raw(spark, sf), d, RECODE_DOMAINS)


# --- aggregates / trends ------------------------------------------------------------------
def _top(column):
    return lambda spark, sf: trends.top_k(clean(spark, sf), column, TOP_K)


def q_count_by_sex(spark, sf):
    return trends.count_by(clean(spark, sf), "vict_sex", name="crime_count")


def q_age_dist(spark, sf):
    return trends.ranked_counts(clean(spark, sf), "vict_age")


def q_age_sex_dist(spark, sf):
    return trends.ranked_counts(clean(spark, sf), "vict_age", "vict_sex")


def q_year_trend(spark, sf):
    return trends.year_trend(clean(spark, sf), exclude_year=EXCLUDED_YEAR)


def q_month_trend(spark, sf):
    return trends.month_trend(clean(spark, sf), *MONTH_RANGE)


def q_weekday_trend(spark, sf):
    return trends.weekday_trend(clean(spark, sf), weekday_dim(spark))


def _by_area(group):
    return lambda spark, sf: trends.by_area(clean(spark, sf), group)


def q_area_by_group_wide(spark, sf):
    return trends.area_by_group_wide(clean(spark, sf), GROUPS)


# --- baskets and rules --------------------------------------------------------------------
def q_basket_build(spark, sf):
    df = filter_placeholders(clean(spark, sf), BASKET_COLUMNS)
    return df.select(patterns.items_text(patterns.basket(BASKET_COLUMNS)).alias("items"))


INCIDENT_SUPPORT, INCIDENT_CONFIDENCE = 0.2, 0.5   # the reference's thresholds


def incident_rule_model(spark, sf):
    def build():
        kept = clean_incidents(raw(spark, sf), dim(spark, sf), keep=("dr_no",))
        baskets = incident_baskets(kept.withColumn("dr_no", classify.row_key("dr_no")), "dr_no")
        return mine_rules(baskets, "dr_no", INCIDENT_SUPPORT, INCIDENT_CONFIDENCE, train_percent=TRAIN_PERCENT)
    return _memo("incident-rules", spark, sf, build)


def q_incident_itemsets(spark, sf):
    return incident_rule_model(spark, sf).itemsets()


def q_incident_rules(spark, sf):
    return incident_rule_model(spark, sf).rules()


def q_incident_rule_predict(spark, sf):
    out = incident_rule_model(spark, sf).predictions()
    return out.select("dr_no", patterns.items_text("items").alias("items"),
                      patterns.items_text("prediction").alias("prediction"))


def event_baskets(spark, sf) -> DataFrame:
    cols = events_basket_columns(spark, sf)
    return cols.select("event_id", patterns.basket(EVENT_ITEM_COLUMNS).alias("items"))


_MODELS: dict = {}
MODEL_TABLES = ["customer", "events", "lineitem", "nation", "orders", "part"]


def _state(spark: SparkSession, sf: str) -> tuple:
    """Count and hash of the names, sizes and times of the files that the models are fitted on (contents unread)."""
    paths = [f"{sf.rstrip('/')}/{name}.parquet" for name in MODEL_TABLES]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return tuple(files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())


def _memo(kind: str, spark: SparkSession, sf: str, build):
    """One fitted model per (kind, session, folder), fitted anew when the folder's files have changed."""
    key, state = (kind, spark.sparkContext.applicationId, sf), _state(spark, sf)
    if key not in _MODELS or _MODELS[key][0] != state:
        old = _MODELS.pop(key, (None, None))[1]
        if isinstance(old, FPGrowthModel):
            patterns.release(old)
        elif hasattr(old, "release"):
            old.release()
        _MODELS[key] = (state, build())
    return _MODELS[key][1]


def event_rule_model(spark, sf):
    def build():
        train, _ = classify.key_split(event_baskets(spark, sf), "event_id", TRAIN_PERCENT)
        return patterns.mine(train, MIN_SUPPORT, MIN_CONFIDENCE)
    return _memo("fpgrowth", spark, sf, build)


def q_freq_itemsets(spark, sf):
    return patterns.freq_itemsets(event_rule_model(spark, sf))


def q_assoc_rules(spark, sf):
    return patterns.assoc_rules(event_rule_model(spark, sf))


def q_rule_predict(spark, sf):
    _, test = classify.key_split(event_baskets(spark, sf), "event_id", TRAIN_PERCENT)
    out = patterns.apply_rules(event_rule_model(spark, sf), test)
    return out.select("event_id", patterns.items_text("items").alias("items"),
                      patterns.items_text("prediction").alias("prediction"))


# --- split, indexing, features ---------------------------------------------------------------
def q_key_split(spark, sf):
    train, test = classify.key_split(raw(spark, sf), classify.row_key("dr_no"), TRAIN_PERCENT)
    part = lambda df, name: df.select("dr_no", F.lit(name).alias("split"))
    return part(train, "train").union(part(test, "test"))


def _index_counts(df, column, out):
    from pyspark.ml.feature import StringIndexer
    model = StringIndexer(inputCol=column, outputCol=out, handleInvalid="skip").fit(df)
    scored = model.transform(df)
    return trends.count_by(scored, F.col(column).alias("value"), F.col(out).cast("int").alias("index"))


def q_string_index(spark, sf):
    return _index_counts(clean(spark, sf), "vict_descent", "descent_index")


def q_label_index(spark, sf):
    return _index_counts(raw(spark, sf), "status_desc", "label")


def q_one_hot(spark, sf):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    df = clean(spark, sf)
    idx = StringIndexer(inputCol="vict_descent", outputCol="idx", handleInvalid="skip").fit(df).transform(df)
    enc = OneHotEncoder(inputCol="idx", outputCol="vec").fit(idx).transform(idx)
    arr = vector_to_array("vec")
    hot = F.array_position(arr, F.lit(1.0)).cast("int") - 1
    return (enc.select(F.col("vict_descent").alias("value"), F.col("idx").cast("int").alias("index"),
                       F.size(arr).alias("size"), hot.alias("hot"))
               .distinct())


ASSEMBLE_INPUTS = ["vict_age", "crm_cd", "premis_cd", "weapon_used_cd"]


def q_assemble(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    df = classify.typed_features(raw(spark, sf))
    asm = VectorAssembler(inputCols=ASSEMBLE_INPUTS, outputCol="features", handleInvalid="skip")
    arr = vector_to_array(F.col("features"))
    return asm.transform(df).select("dr_no", *[arr[i].alias(f"f_{c}") for i, c in enumerate(ASSEMBLE_INPUTS)])


def q_assemble_skipped(spark, sf):
    return classify.skipped_rows(classify.typed_features(raw(spark, sf)), ASSEMBLE_INPUTS)


def q_index_five(spark, sf):
    """The joint index of the five categories: rows kept (no NULL in any of them) per input and value."""
    from pyspark.ml.feature import StringIndexer
    df = raw(spark, sf).select(*classify.CATEGORICAL)
    codes = [f"{c}_index" for c in classify.CATEGORICAL]
    model = StringIndexer(inputCols=classify.CATEGORICAL, outputCols=codes, handleInvalid="skip").fit(df)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).alias("value"), F.col(i).cast("int").alias("index"))
                               for c, i in zip(classify.CATEGORICAL, codes)])).alias("e")
    return trends.count_by(model.transform(df).select(each).select("e.*"), "input", "value", "index")


def q_address_hashed(spark, sf):
    df = raw(spark, sf).select("location").filter("location is not null")
    arr = vector_to_array(F.col("code"))
    out = classify.hasher("location", "code").transform(df).select(
        "location", F.array_position(arr, F.lit(1.0)).alias("slot"), F.size(arr).alias("width"),
        F.size(F.filter(arr, lambda x: x != 0)).alias("nonzero"))
    return out.groupBy("location").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("slot").alias("slots"),
                                       F.max("width").alias("width"), F.max("nonzero").alias("nonzero"))


def q_assemble_nine(spark, sf):
    """The classifier's input vector of every row it keeps, read back slot by slot."""
    from pyspark.ml import Pipeline
    inputs = [c for c in classify.FEATURES if not c.endswith("_encoded")]
    rows = classify.typed_features(raw(spark, sf)).filter("location is not null")
    df = stored(rows.select(*dict.fromkeys(["dr_no", *classify.CATEGORICAL, "status_desc", *inputs])), "assembler-rows")
    indexed = [c for c in classify.CATEGORICAL if c != "location"]
    stages = classify.build_pipeline(indexed, label_source="status_desc", hashed=["location"]).getStages()[:-1]
    out = Pipeline(stages=stages).fit(df).transform(df)
    owners = classify.slot_owners(out.schema, classify.FEATURES)
    arr = F.col("slots")
    block = lambda c: F.slice(arr, owners.index(c) + 1, owners.count(c))
    return out.select("dr_no", vector_to_array("features").alias("slots")).select(
        "dr_no", F.size(arr).alias("width"),
        *[F.element_at(arr, owners.index(c) + 1).alias(f"f_{c}") for c in classify.FEATURES if not c.endswith("_encoded")],
        *[(F.array_position(block(f"{c}_encoded"), F.lit(1.0)).cast("int") - 1).alias(f"hot_{c}")
          for c in indexed if f"{c}_encoded" in owners],
        F.size(F.filter(block("location_encoded"), lambda x: x != 0)).alias("nonzero_location"))


def _baseline(spark, sf):
    train, test = classify.key_split(raw(spark, sf).select("dr_no", "premis_desc", "status_desc"),
                                     classify.row_key("dr_no"), TRAIN_PERCENT)
    return classify.baseline(train, test, "premis_desc")


def q_baseline_accuracy(spark, sf):
    return classify.accuracy(_baseline(spark, sf))


def q_baseline_confusion(spark, sf):
    return classify.confusion(_baseline(spark, sf))


# --- random forest ---------------------------------------------------------------------------
def forest(spark, sf):
    """Fit once per session and scale (the forest queries share it)."""
    def build():
        return train_classifier(raw(spark, sf), classify.row_key("dr_no"), TRAIN_PERCENT)
    return _memo("forest", spark, sf, build)


def q_rf_scored_keys(spark, sf):
    return forest(spark, sf).scored.select("dr_no", F.col("label").cast("int").alias("label"), "vict_age",
                                           *classify.CATEGORICAL, "status_desc")


def q_rf_predict(spark, sf):
    return forest(spark, sf).predictions()


def q_rf_accuracy(spark, sf):
    return forest(spark, sf).accuracy()


def q_confusion(spark, sf):
    return forest(spark, sf).confusion()


def q_rf_importance(spark, sf):
    return spark.createDataFrame(forest(spark, sf).importances(), "feature string, importance double")


def forest_onehot(spark, sf):
    """The reference's exact form: the address one-hot encoded."""
    def build():
        return train_classifier(raw(spark, sf), classify.row_key("dr_no"), TRAIN_PERCENT,
                                location_encoding="onehot")
    return _memo("forest-onehot", spark, sf, build)


def q_rf_onehot_accuracy(spark, sf):
    return forest_onehot(spark, sf).accuracy()


def q_rf_onehot_importance(spark, sf):
    return spark.createDataFrame(forest_onehot(spark, sf).importances(), "feature string, importance double")


QUERIES: dict[str, Query] = {
    "csv_roundtrip": q_csv_roundtrip,
    "clean_sink_roundtrip": q_clean_sink_roundtrip,
    "clean_stream_roundtrip": q_clean_stream_roundtrip,
    "row_count": q_row_count,
    "preview": q_preview,
    "select_cols": q_select_cols,
    "drop_cols": q_drop_cols,
    "derive_cols": q_derive_cols,
    "cast_int": q_cast_int,
    "cast_double": q_cast_double,
    "null_profile": q_null_profile,
    "distinct_values": q_distinct_values,
    "date_text_norm": q_date_text_norm,
    "time_norm": q_time_norm,
    "parse_date": q_parse_date,
    "month_day_names": q_month_day_names,
    "filter_not_in_int": q_filter_not_in_int,
    "filter_not_in_str": q_filter_not_in_str,
    "filter_rule_counts": q_filter_rule_counts,
    "filter_placeholders": q_filter_placeholders,
    "recode_sex": q_recode_sex,
    "recode_descent": q_recode_descent,
    "recode_crime": q_recode_crime,
    "recode_premise": q_recode_premise,
    "recode_weapon": q_recode_weapon,
    "recode_dim_profile": q_recode_dim_profile,
    "recode_unmapped": q_recode_unmapped,
    "top_crime": _top("crm_cd_desc"),
    "top_weapon": _top("weapon_desc"),
    "top_area": _top("area_name"),
    "top_descent": _top("vict_descent"),
    "count_by_sex": q_count_by_sex,
    "age_dist": q_age_dist,
    "age_sex_dist": q_age_sex_dist,
    "year_trend": q_year_trend,
    "month_trend": q_month_trend,
    "weekday_trend": q_weekday_trend,
    "count_by_area_hispanic": _by_area("Hispanic/Latin"),
    "count_by_area_black": _by_area("Black"),
    "count_by_area_white": _by_area("White"),
    "area_by_group_wide": q_area_by_group_wide,
    "basket_build": q_basket_build,
    "incident_itemsets": q_incident_itemsets,
    "incident_rules": q_incident_rules,
    "incident_rule_predict": q_incident_rule_predict,
    "freq_itemsets": q_freq_itemsets,
    "assoc_rules": q_assoc_rules,
    "rule_predict": q_rule_predict,
    "key_split": q_key_split,
    "string_index": q_string_index,
    "label_index": q_label_index,
    "one_hot": q_one_hot,
    "assemble": q_assemble,
    "assemble_skipped": q_assemble_skipped,
    "index_five": q_index_five,
    "address_hashed": q_address_hashed,
    "assemble_nine": q_assemble_nine,
    "baseline_accuracy": q_baseline_accuracy,
    "baseline_confusion": q_baseline_confusion,
    "rf_scored_keys": q_rf_scored_keys,
    "rf_predict": q_rf_predict,
    "rf_accuracy": q_rf_accuracy,
    "confusion": q_confusion,
    "rf_importance": q_rf_importance,
    "rf_onehot_accuracy": q_rf_onehot_accuracy,
    "rf_onehot_importance": q_rf_onehot_importance,
}
