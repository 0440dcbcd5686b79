import pytest
from pyspark.sql import functions as F

import blotter.operators.recode as checks
from blotter.operators.recode import (
    DictionaryError,
    check_dim,
    coverage,
    dim_profile,
    merge_passes,
    recode,
    recode_literal,
)
from blotter.sources.dims import recode_dim

MAP = {"BUS STOP": "Public Transportation", "TRAIN": "Public Transportation", "null": "Unknown",
       "Waterfront Area": "Waterfront Area", "DRUG STORE": "Commercial"}
VALUES = list(MAP) + [None, "bus stop", "UNMAPPED", "Unknown"]


def _facts(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALUES * 3)], "id int, c string")


def _chained(df, mapping):
    for k, v in mapping.items():
        df = df.replace(k, v, "c")
    return df


def _result(df):
    return sorted((r.id, r.c) for r in df.select("id", "c").collect())


@pytest.mark.parametrize("max_rows", [100_000, 0])
def test_recode_equals_chained_replace(spark, max_rows):
    facts = _facts(spark)
    dim = recode_dim(spark, {"premise": MAP})
    want = _result(_chained(facts, MAP))
    assert _result(recode(facts, "c", dim, "premise", max_broadcast_rows=max_rows)) == want
    assert _result(recode_literal(facts, "c", MAP)) == want
    got = dict(_result(recode(facts, "c", dim, "premise")))
    assert got[VALUES.index(None)] is None             # NULL stays NULL
    assert got[VALUES.index("bus stop")] == "bus stop"  # other case passes through
    assert got[VALUES.index("null")] == "Unknown"      # text null is a key


def test_repeated_key_same_target_keeps_row_count(spark):
    facts = _facts(spark)
    dim = recode_dim(spark, [("p", "TRAIN", "Rail"), ("p", "TRAIN", "Rail")])
    assert recode(facts, "c", dim, "p").count() == facts.count()
    assert recode(facts, "c", dim, "p", max_broadcast_rows=0).count() == facts.count()


def test_conflicting_key_rejected(spark):
    dim = recode_dim(spark, [("p", "TRAIN", "Rail"), ("p", "TRAIN", "Bus")])
    with pytest.raises(DictionaryError):
        recode(_facts(spark), "c", check_dim(dim), "p")
    with pytest.raises(DictionaryError):
        recode(_facts(spark), "c", dim, "p", max_broadcast_rows=0)


def test_merge_passes_equals_two_passes(spark):
    p1 = {"A": "X", "B": "Y", "C": "C"}
    p2 = {"Y": "Z", "D": "W", "A": "never"}
    dim = recode_dim(spark, {"one": p1, "two": p2})
    facts = spark.createDataFrame([(i, v) for i, v in enumerate(["A", "B", "C", "D", "E", None])],
                                  "id int, c string")
    want = _result(_chained(_chained(facts, p1), p2))
    for d in (dim, check_dim(dim)):
        merged = merge_passes(d, "one", "two")
        assert _result(recode(facts, "c", merged, "one")) == want
    assert dict(want)[1] == "Z" and dict(want)[0] == "X"


def test_coverage_and_profile(spark):
    facts = _facts(spark)
    dim = recode_dim(spark, {"premise": MAP})
    unm = {(r.value, r.n) for r in coverage(facts, "c", dim, "premise").collect()}
    assert unm == {("bus stop", 3), ("UNMAPPED", 3), ("Unknown", 3)}
    prof = dim_profile(dim).first()
    assert (prof.entries, prof.keys, prof.targets) == (5, 5, 4)


def test_recode_plan_is_broadcast(spark):
    dim = recode_dim(spark, {"premise": MAP})
    plan = recode(_facts(spark), "c", dim, "premise")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert F  # keep import


@pytest.mark.parametrize("max_rows", [100_000, 0])
def test_chained_dictionary_rejected(spark, max_rows):
    dim = recode_dim(spark, [("p", "A", "B"), ("p", "B", "C"), ("p", "C", "C")])
    with pytest.raises(DictionaryError):
        recode(_facts(spark), "c", dim, "p", max_broadcast_rows=max_rows)
    ok = recode_dim(spark, [("p", "A", "B"), ("p", "B", "B")])   # identity target: no chain
    assert recode(_facts(spark), "c", ok, "p", max_broadcast_rows=max_rows).count() == len(VALUES) * 3


def test_profile_from_one_pass_equals_separate(spark):
    from blotter.operators.profile import ValueCounts, distinct_values_many
    from blotter.operators.recode import coverage_from_counts, coverage_many
    facts = _facts(spark).withColumn("d", F.upper("c"))
    dim = recode_dim(spark, {"premise": MAP, "other": {"A": "B"}})
    cols = {"c": "premise", "d": "other"}
    vc = ValueCounts(facts, ["c", "d"])
    a = sorted(map(tuple, coverage_from_counts(vc.table, dim, cols).collect()))
    b = sorted(map(tuple, coverage_many(facts, dim, cols).collect()))
    assert a == b and a
    x = sorted(map(tuple, vc.distinct_values(["c"]).collect()), key=str)
    y = sorted(map(tuple, distinct_values_many(facts, ["c"]).collect()), key=str)
    assert x == y
    vc.release()


@pytest.mark.parametrize("limit", [0, 100_000])
def test_same_outcome_at_any_size(spark, limit):
    """The limit chooses the join, never the answer."""
    rows = [("one", "A", "D"), ("two", "X", "A"), ("other", "k", "1"), ("other", "k", "2"), ("same", "s", "s"), ("same", "s", "s")]
    dim = checks.check_dim(spark.createDataFrame(rows, "domain string, raw string, target string"), limit)
    df = spark.createDataFrame([("A",), ("X",), ("s",), (None,)], "c string")
    out = lambda d, name: sorted((r.c or "-") for r in checks.recode(df, "c", d, name, limit).collect())
    merged = checks.merge_passes(dim, "one", "two", into="both", max_broadcast_rows=limit)
    assert out(merged, "both") == sorted(["D", "A", "s", "-"])      # A -> D, X -> A, as two chained replaces
    assert out(dim, "same") == sorted(["A", "X", "s", "-"])         # a conflict in a domain nobody asks for is no error
    with pytest.raises(checks.DictionaryError):
        checks.recode(df, "c", dim, "other", limit)
