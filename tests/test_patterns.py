import itertools
import math
from collections import Counter

from pyspark.sql import functions as F

from blotter.operators.patterns import apply_rules, assoc_rules, basket, freq_itemsets, mine


def test_basket_drops_null_and_repeats(spark):
    df = spark.createDataFrame([("a", "a", "b"), ("a", None, "c")], "x string, y string, z string")
    got = [sorted(r.items) for r in df.select(basket(["x", "y", "z"]).alias("items")).collect()]
    assert got == [["a", "b"], ["a", "c"]]


def _brute_force(baskets, min_support):
    n = len(baskets)
    counts = Counter()
    for b in baskets:
        for k in range(1, len(b) + 1):
            for combo in itertools.combinations(sorted(b), k):
                counts[combo] += 1
    need = math.ceil(min_support * n)
    return {",".join(k): v for k, v in counts.items() if v >= need}


def test_fpgrowth_matches_brute_force(spark):
    rows = [("x", "p", "u"), ("x", "p", "v"), ("x", "q", "u"), ("y", "p", "u"), ("x", "p", "u"),
            ("y", "q", "v"), ("x", "p", "u"), ("y", "p", "v")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    baskets = df.select(basket(["a", "b", "c"]).alias("items"))
    model = mine(baskets, 0.25, 0.6)
    got = {r.items: r.freq for r in freq_itemsets(model).collect()}
    assert got == _brute_force([set(r) for r in rows], 0.25)
    n = len(rows)
    for r in assoc_rules(model).collect():
        z = ",".join(sorted(r.antecedent.split(",") + [r.consequent]))
        assert abs(r.confidence - round(got[z] / got[r.antecedent], 6)) < 1e-9
        assert abs(r.support - round(got[z] / n, 6)) < 1e-9
        assert r.confidence >= 0.6


def test_rule_application_and_null(spark):
    rows = [("x", "p"), ("x", "p"), ("x", "p"), ("y", "q")]
    df = spark.createDataFrame(rows, "a string, b string")
    model = mine(df.select(basket(["a", "b"]).alias("items")), 0.5, 0.5)
    test = spark.createDataFrame([(["x"],), (None,), (["x", "p"],)], "items array<string>")
    preds = [r.prediction for r in apply_rules(model, test).collect()]
    assert preds == [["p"], [], []]


def test_mine_does_not_refuse_by_a_bound(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "c", "d", "b"],)] * 25, "items array<string>")
    model = mine(df, 0.2, 0.5)
    assert freq_itemsets(model).count() == 15
