from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from blotter.operators import classify


def test_key_split_deterministic(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    a_train, a_test = classify.key_split(df.repartition(1), "k", 80)
    b_train, b_test = classify.key_split(df.repartition(7), "k", 80)
    assert sorted(r.k for r in a_train.collect()) == sorted(r.k for r in b_train.collect())
    assert a_train.count() + a_test.count() == 5000
    assert 3800 < a_train.count() < 4200


def test_index_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "c"]], "v string")
    assert StringIndexer(inputCol="v", outputCol="i").fit(df).labels == ["c", "a", "b"]


def test_pipeline_metrics_and_importances(spark):
    rows = [(f"s{i % 3}", f"d{i % 5}", float(i % 7), ["L0", "L1"][(i % 3 == 0)]) for i in range(600)]
    df = spark.createDataFrame(rows, "sex string, desc string, age double, status string")
    pipe = classify.build_pipeline(categorical=["sex", "desc"], features=["age", "sex_encoded", "desc_encoded"],
                                   label_source="status", num_trees=5, seed=7)
    model = pipe.fit(df)
    scored = model.transform(df)
    acc = classify.accuracy(scored).first()
    conf = classify.confusion(scored).collect()
    assert sum(r["count"] for r in conf) == acc.scored == 600
    trace = sum(r["count"] for r in conf if r.label == r.prediction)
    assert abs(acc.accuracy - trace / acc.scored) < 1e-12
    imp = dict(classify.importances_by_input(model, scored, ["age", "sex_encoded", "desc_encoded"]))
    assert set(imp) == {"age", "sex_encoded", "desc_encoded"}
    assert abs(sum(imp.values()) - 1.0) < 1e-9
    assert imp["sex_encoded"] > 0.5            # the label is a function of sex
    again = pipe.fit(df).transform(df)
    assert [r.prediction for r in again.select("prediction").collect()] == \
           [r.prediction for r in scored.select("prediction").collect()]
    named = classify.decode_prediction(scored, classify.label_names(model))
    assert set(r.predicted for r in named.select("predicted").distinct().collect()) <= {"L0", "L1"}


def test_split_holds_every_row(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,), ("x-7",), ("",), (None,)], "k string")
    for key in (F.col("k").try_cast("long"), classify.row_key("k")):
        train, test = classify.key_split(df, key, 50)
        assert train.count() + test.count() == 6


def test_slot_owners_by_width(spark):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    df = spark.createDataFrame([(1.0, "b_x"), (2.0, "y"), (3.0, "z")], "a_b double, v string")
    df = StringIndexer(inputCol="v", outputCol="i").fit(df).transform(df)
    df = OneHotEncoder(inputCol="i", outputCol="a").fit(df).transform(df)
    df = VectorAssembler(inputCols=["a", "a_b"], outputCol="features").transform(df)
    assert classify.slot_owners(df.schema, ["a", "a_b"]) == ["a", "a", "a_b"]


def test_fold_slots():
    got = classify.fold_slots([0.5, 0.25, 0.125, 0.125], ["a", "b", "b", "a"], ["b", "a", "c"])
    assert got == [("b", 0.375), ("a", 0.625), ("c", 0.0)]


def test_hasher_width_and_slots(spark):
    from pyspark.ml.functions import vector_to_array
    df = spark.createDataFrame([(f"street {i % 50}",) for i in range(200)] + [("",)], "location string")
    arr = vector_to_array(F.col("v"))
    out = classify.hasher("location", "v", 16).transform(df).select("location", arr.alias("a")).collect()
    assert all(len(r.a) == 16 and sum(r.a) == 1.0 for r in out)
    assert len({(r.location, tuple(r.a)) for r in out}) == 51


def test_baseline_ties_unseen_and_null(spark):
    train = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "y"), ("c", "x"), (None, "x"), ("d", None)],
                                  "by string, s string")
    test = spark.createDataFrame([("a", "x"), ("b", "x"), ("new", "y"), (None, "x"), ("c", "x"), ("c", "z"), ("d", "x")],
                                 "by string, s string")
    got = {r.by: (r.label, r.prediction) for r in classify.baseline(train, test, "by", "s").collect()}
    # y is the more frequent label (index 0): it wins the tie of a, and the values never seen
    assert got == {"a": (1.0, 0.0), "b": (1.0, 0.0), "new": (0.0, 0.0), "c": (1.0, 1.0), "d": (1.0, 0.0)}


def test_address_forms(spark, sf):
    from blotter.plans.classification import train_classifier
    from blotter.plans.queries import raw
    r = raw(spark, sf)
    key = classify.row_key("dr_no")
    for mode, feature in (("hashed", "location_encoded"), ("onehot", "location_encoded"), ("frequency", "location_freq")):
        c = train_classifier(r, key, num_trees=3, location_encoding=mode)
        acc = c.accuracy().first()
        assert acc.scored > 0
        conf = {(x.label, x.prediction): x["count"] for x in c.confusion().collect()}
        recount = c.scored.select("label", "prediction").collect()
        assert acc.correct == sum(x.label == x.prediction for x in recount) == sum(n for (a, b), n in conf.items() if a == b)
        largest = max(sum(n for (a, _), n in conf.items() if a == k) for k in {a for a, _ in conf})
        assert acc.accuracy > largest / acc.scored + 0.1     # clearly better than one class for all
        lost = c.skipped().first()
        assert lost.rows == lost.skipped + lost.unseen + lost.scored and lost.unseen >= 0
        imp = dict(c.importances())
        assert feature in imp and abs(sum(imp.values()) - 1) < 1e-9
        assert c.predictions().count() == acc.scored


def test_frequency_encode_unseen_and_null(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "loc string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "loc string")
    _, (enc,) = classify.frequency_encode(train, [test], "loc", "f")
    got = {r.loc: r.f for r in enc.collect()}
    assert got == {"a": 2.0, "z": 0.0, None: None}


def test_frequency_encode_hot_key_shuffle_path(spark):
    # one address holds a third of the rows; no broadcast hint, and Catalyst's own
    # size-based broadcast switched off, so the shuffle join really runs
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("hot",)] * 300 + [(f"a{i}",) for i in range(600)]
        train = spark.createDataFrame(rows, "loc string").repartition(4)
        test = spark.createDataFrame([("hot",), ("a1",), ("new",)], "loc string")
        enc_train, (enc_test,) = classify.frequency_encode(train, [test], "loc", "f", max_broadcast_rows=0)
        assert enc_train.count() == 900
        assert {r.loc: r.f for r in enc_test.collect()} == {"hot": 300.0, "a1": 1.0, "new": 0.0}
        plan = enc_test._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_skipped_rows_counted(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (None, None), (3.0, 4.0)], "a double, b double")
    r = classify.skipped_rows(df, ["a", "b"]).first()
    assert (r.rows, r.skipped, r.null_a, r.null_b) == (4, 2, 2, 1)
    from pyspark.ml.feature import VectorAssembler
    kept = VectorAssembler(inputCols=["a", "b"], outputCol="v", handleInvalid="skip").transform(df).count()
    assert kept == r.rows - r.skipped


# --- the forest, checked node by node ---------------------------------------------
def _walk(node):
    """A tree node of the fitted model as plain numbers: (counts, gain, None) or (counts, gain, (feature, test, left, right))."""
    counts = [float(x) for x in node.impurityStats().stats()]
    if node.subtreeDepth() == 0:
        return counts, 0.0, None
    split = node.split()
    if "Categorical" in split.getClass().getSimpleName():
        left = set(float(x) for x in split.leftCategories())
        test = lambda v, left=left: v in left
    else:
        at = split.threshold()
        test = lambda v, at=at: v <= at
    return counts, float(node.gain()), (split.featureIndex(), test, _walk(node.leftChild()), _walk(node.rightChild()))


def test_forest_scores_and_importances_follow_from_its_trees(spark, sf):
    """Predictions, confusion and importances recomputed in Python from the exported nodes."""
    from collections import Counter, defaultdict

    from blotter.plans.classification import train_classifier
    from blotter.sources.standin import raw_incidents
    got = train_classifier(raw_incidents(spark, sf), classify.row_key("dr_no"))
    forest = got.model.stages[-1]
    trees = [_walk(t._java_obj.rootNode()) for t in forest.trees]
    labels = classify.label_names(got.model)
    rows = got.assembled.select("features", "label", "prediction", "status_desc").collect()
    assert len(rows) > 500
    matrix = Counter()
    for r in rows:
        votes = [0.0] * len(labels)
        for tree in trees:
            counts, _, split = tree
            while split:
                feature, test, left, right = split
                counts, _, split = left if test(float(r.features[feature])) else right
            total = sum(counts)
            votes = [v + c / total for v, c in zip(votes, counts)]
        best = max(votes)
        assert votes[int(r.prediction)] >= best - 1e-9 and labels[int(r.label)] == r.status_desc
        matrix[int(r.label), int(r.prediction)] += 1
    assert {(r.label, r.prediction): r["count"] for r in got.confusion().collect()} == matrix
    acc = got.accuracy().first()
    assert acc.scored == len(rows) and acc.correct == sum(n for (a, b), n in matrix.items() if a == b)
    total = defaultdict(float)
    for tree in trees:
        own, todo = defaultdict(float), [tree]
        while todo:
            counts, gain, split = todo.pop()
            if split:
                own[split[0]] += gain * sum(counts)
                todo += [split[2], split[3]]
        whole = sum(own.values())
        for f, x in own.items():
            total[f] += x / whole
    whole = sum(total.values())
    owners = classify.slot_owners(got.assembled.schema, got.features)
    want = defaultdict(float)
    for f, x in total.items():
        want[owners[f]] += x / whole
    for name, x in got.importances():
        assert abs(x - want[name]) < 1e-9, name
    shown = got.predictions()
    assert shown.columns[-2:] == ["prediction", "predicted"] and shown.count() == len(rows)
    assert all(labels[r.prediction] == r.predicted for r in shown.select("prediction", "predicted").collect())
