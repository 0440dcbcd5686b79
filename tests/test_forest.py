"""The forest whose one-hot slots are never laid out, against Spark ML's."""

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from blotter.operators import classify, forest
from blotter.operators.index import ExactIndex


def _incidents(spark, n=3000, addresses=400):
    rng = np.random.default_rng(5)
    street = (rng.random(n) ** 2 * addresses).astype(int)
    age, kind = rng.integers(0, 70, n), rng.integers(0, 5, n)
    noise = rng.random(n)
    status = np.where(noise < 0.1, 2, np.where((age > 30) ^ (kind == 1), 1, np.where(street < 12, 2, 0)))
    rows = [(i, f"k{k}", f"street {s}", float(a), f"s{x}") for i, (k, s, a, x) in
            enumerate(zip(kind.tolist(), street.tolist(), age.tolist(), status.tolist()))]
    return spark.createDataFrame(rows, "id long, kind string, location string, age double, status string")


FEATURES = ["age", "kind_encoded", "location_encoded"]


def _wide(df, test, **params):
    index = ExactIndex(df, ["location"])
    pipe = classify.build_pipeline(["kind"], ["age", "kind_encoded"], label_source="status", **params)
    coded = index.transform(df, "location", "location_index")
    model = classify.fit_wide(pipe, coded, index, "location", FEATURES)
    return model, model.transform(index.transform(test, "location", "location_index"))


def _rows(scored):
    return {r.id: (r.label, r.prediction, tuple(round(x, 9) for x in r.probability))
            for r in scored.select("id", "label", "prediction", "probability").collect()}


def test_a_tree_without_draws_is_equal_to_spark_mls(spark):
    df = _incidents(spark)
    test = df.unionByName(spark.createDataFrame([(-1, "k1", "no such street", 5.0, "s0"), (-2, "k1", None, 5.0, "s0"),
                                                 (-3, "k1", "street 0", None, "s0")], df.schema))
    params = dict(num_trees=1, seed=3, bootstrap=False)
    dense = classify.build_pipeline(["kind", "location"], FEATURES, label_source="status", **params).fit(df)
    laid_out = dense.transform(test)
    model, scored = _wide(df, test, **params)
    assert _rows(scored) == _rows(laid_out) and set(_rows(scored)) == set(range(3000))
    want = dict(classify.importances_by_input(dense, laid_out, FEATURES))
    got = dict(classify.importances_by_input(model, scored, FEATURES))
    assert want["location_encoded"] > 0 and got == pytest.approx(want, abs=1e-9)
    assert np.allclose(model.stages[-1].featureImportances.toArray(), dense.stages[-1].featureImportances.toArray())


def test_forests_with_draws_agree_in_quality(spark):
    df = _incidents(spark, addresses=8)      # few slots: many draws hit the same ones, so luck matters little
    params = dict(num_trees=10, seed=3)
    laid_out = classify.build_pipeline(["kind", "location"], FEATURES, label_source="status", **params).fit(df).transform(df)
    model, scored = _wide(df, df, **params)
    want, got = classify.accuracy(laid_out).first(), classify.accuracy(scored).first()
    assert got.scored == want.scored == 3000 and abs(got.accuracy - want.accuracy) < 0.1
    assert sum(x for _, x in classify.importances_by_input(model, scored, FEATURES)) == pytest.approx(1)
    assert len(model.stages[-1].owners()) == model.stages[-1].slots.total == 1 + 4 + 7
    again, _ = _wide(df, df, **params)
    assert again.stages[-1].gains.keys() == model.stages[-1].gains.keys()


def test_wide_addresses_are_not_laid_out(spark, sf, monkeypatch):
    from blotter.plans.classification import train_classifier
    from blotter.plans.queries import raw
    key = classify.row_key("dr_no")
    want = train_classifier(raw(spark, sf), key, location_encoding="onehot")
    monkeypatch.setattr(classify, "LAID_OUT_BYTES", 0)
    monkeypatch.setattr(classify.RandomForestClassifier, "fit", lambda *a: pytest.fail("slots were laid out"))
    got = train_classifier(raw(spark, sf), key, location_encoding="onehot")
    keys = lambda c: sorted((r.dr_no or "", r.label) for r in c.scored.select("dr_no", "label").collect())
    assert keys(got) == keys(want) and got.skipped().first() == want.skipped().first()
    acc, conf = got.accuracy().first(), got.confusion().collect()
    assert acc.scored == sum(r["count"] for r in conf) and acc.correct == sum(r["count"] for r in conf if r.label == r.prediction)
    assert acc.accuracy > 0.6 and abs(acc.accuracy - want.accuracy().first().accuracy) < 0.15
    assert [f for f, _ in got.importances()] == classify.FEATURES and sum(x for _, x in got.importances()) == pytest.approx(1)
    assert got.predictions().count() == acc.scored


def test_the_importance_query_sums_slots_that_are_not_laid_out(spark, sf, monkeypatch):
    from blotter.plans import queries
    monkeypatch.setattr(classify, "LAID_OUT_BYTES", 0)
    monkeypatch.setattr(queries, "_memo", lambda kind, spark, sf, build: build())
    monkeypatch.setattr(classify.RandomForestClassifier, "fit", lambda *a: pytest.fail("slots were laid out"))
    fits, fit = [], classify.fit_forest
    monkeypatch.setattr(classify, "fit_forest", lambda *a: fits.append(fit(*a)) or fits[-1])
    got = {r.feature: r.importance for r in queries.q_rf_onehot_importance(spark, sf).collect()}
    model, = fits
    want = dict.fromkeys(classify.FEATURES, 0.0)
    for t in range(10):
        own = [(slot, gain * sum(model.counts[at])) for at, (slot, gain) in model.gains.items() if at[0] == t]
        for slot, x in own:
            want[model.owners()[slot]] += x / sum(y for _, y in own)
    whole = sum(want.values())
    assert list(got) == classify.FEATURES and got == pytest.approx({f: x / whole for f, x in want.items()})


def test_width_decides(spark):
    df = spark.createDataFrame([(f"a{i}",) for i in range(100)], "location string")
    assert classify.too_wide(df, "location", 100 * 500) and not classify.too_wide(df, "location", 100 * 700)
    assert not classify.too_wide(df, "location")


def test_constant_inputs_and_pure_labels(spark):
    df = _incidents(spark, 200, 1).withColumn("age", F.lit(1.0))
    model, scored = _wide(df, df, num_trees=2)
    used = {slot for slot, _ in model.stages[-1].gains.values()}
    assert scored.count() == 200 and used <= {1, 2, 3, 4} and model.stages[-1].slots.total == 5
    pure = _incidents(spark, 200).withColumn("status", F.lit("s"))
    model, scored = _wide(pure, pure, num_trees=2)
    assert {r.prediction for r in scored.collect()} == {0.0} and model.stages[-1].gains == {}
    assert not model.stages[-1].featureImportances.toArray().any()


def test_cut_points():
    assert forest.cut_points([(1.0, 5), (2.0, 5), (4.0, 1)], 11) == [1.5, 3.0]
    assert forest.cut_points([(7.0, 9)], 9) == []
    many = forest.cut_points([(float(i), 1) for i in range(320)], 320)
    assert len(many) == 31 and many[0] == 9.5


def test_thresholds_are_counted_in_one_pass(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 3), float(i % 70), 1.0) for i in range(700)], "a double, b double, c double")
    passes, one_by_one = [], type(df).toLocalIterator
    monkeypatch.setattr(type(df), "toLocalIterator", lambda self, *a: passes.append(1) or one_by_one(self, *a))
    got = forest.thresholds(df, ["b", "a", "c"], 700)
    assert got["a"] == [0.5, 1.5] and got["c"] == [] and len(passes) == 1
    assert got["b"] == forest.cut_points([(float(i), 10) for i in range(70)], 700) and len(got["b"]) == 31
    assert forest.thresholds(df, [], 700) == {}


def test_stages_beside_the_forest_do_not_join_the_address_indexes(spark, sf, monkeypatch):
    from blotter.plans.classification import train_classifier
    from blotter.plans.queries import raw
    monkeypatch.setattr(classify, "LAID_OUT_BYTES", 0)
    fitted, fit, wide, fit_wide = [], classify.Pipeline.fit, [], classify.fit_wide
    monkeypatch.setattr(classify.Pipeline, "fit", lambda self, df: fitted.append(df.columns) or fit(self, df))
    monkeypatch.setattr(classify, "fit_wide", lambda *a: wide.append(a) or fit_wide(*a))
    got = train_classifier(raw(spark, sf), classify.row_key("dr_no"), location_encoding="onehot")
    assert fitted and not any("location_index" in columns for columns in fitted)
    (pipeline, joined, _, _, _, plain), = wide
    assert joined.count() == plain.count() > 0
    whole = fit(classify.Pipeline(stages=pipeline.getStages()[:-1]), joined)      # as on the joined rows
    assert [list(x) for x in got.model.stages[0].labelsArray] == [list(x) for x in whole.stages[0].labelsArray]


def test_rank_index_is_the_indexers(spark):
    df = _incidents(spark)
    labels = StringIndexer(inputCol="location", outputCol="i").fit(df).labels
    assert [r.value for r in ExactIndex(df, ["location"]).ranks("location").orderBy("index").collect()] == labels
