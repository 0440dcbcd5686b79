"""Exact indexes, quarantine, incremental report, importance, itemsets, repairs, splits, AUC, clustered layer, heavy hitters."""
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry_mod
from blotter.operators import classify, evaluate, heavy, itemsets, ranks, repair
from blotter.operators.index import HOT, ExactIndex
from blotter.plans.deep_oracle import deep_sql
from blotter.plans.deep_queries import DEEP_QUERIES
from blotter.session import shared_dir
from blotter.sources import zlayer
from blotter.sources.quarantine import split_csv
from tools.check_oracle import TABLES, digest


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_deep_query_has_sql():
    assert set(deep_sql()) == set(DEEP_QUERIES) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", sorted(DEEP_QUERIES))
def test_query_matches_oracle(spark, sf, con, name):
    df = DEEP_QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(deep_sql()[name])
    names = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(names) and rows
    assert digest(df.columns, rows) == digest(names, want)


# --- ranks and indexes ------------------------------------------------------------
def test_positions_and_running_sums(spark):
    df = spark.range(1000).selectExpr("pmod(id * 7919, 100) as k", "id", "id % 3 as x")
    got = sorted(map(tuple, ranks.running_sums(df, [F.col("k"), F.col("id")], ["x"]).select("k", "id", "x", "before_x").collect()))
    assert [r[3] for r in got] == [sum(r[2] for r in got[:i]) for i in range(1000)]
    at = sorted(map(tuple, ranks.dense_positions(df, [F.col("k").desc(), F.col("id")], "i").select("i", "k", "id").collect()))
    assert [r[0] for r in at] == list(range(1000)) and [r[1:] for r in at] == sorted((r[1:] for r in at), key=lambda r: (-r[0], r[1]))
    assert ranks.dense_positions(df.limit(0), [F.col("k")], "i").collect() == []


def test_index_of_a_large_skewed_vocabulary(spark):
    """A third of the rows are one value, more different values than are broadcast; NULLs and unseen values."""
    rows = [("hot",)] * 4000 + [(f"v{i:05}",) for i in range(HOT + 700)] * 2 + [("once",), (None,), (None,)]
    df = spark.createDataFrame(rows, "v string")
    index = ExactIndex(df, ["v"])
    counts = Counter(r[0] for r in rows if r[0])
    want = {v: i for i, (v, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    assert {r.value: r["index"] for r in index.ranks("v").collect()} == want and index.sizes == {"v": len(want)}
    out = index.transform(df, "v", "i").collect()
    assert len(out) == len(rows) - 2 and all(want[r.v] == r.i for r in out)
    more = df.union(spark.createDataFrame([("unseen",)], "v string"))
    assert Counter(r.i for r in index.transform(more, "v", "i", "keep").collect())[len(want)] == 3
    assert index.transform(more, "v", "i").count() == len(rows) - 2
    assert "StringIndexer" not in plan(index.transform(df, "v", "i"))


def test_index_equals_the_indexers(spark, sf):
    from pyspark.ml.feature import StringIndexer
    from blotter.sources.standin import raw_incidents
    df = raw_incidents(spark, sf).select("premis_desc", "location")
    index = ExactIndex(df, ["premis_desc", "location"])
    for c in df.columns:
        labels = StringIndexer(inputCol=c, outputCol="i", handleInvalid="skip").fit(df).labels
        assert [r.value for r in index.ranks(c).orderBy("index").collect()] == list(labels)


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], "v string")
    assert ExactIndex(empty, ["v"]).transform(empty, "v", "i").collect() == []


# --- quarantine -------------------------------------------------------------------
SMALL = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b c", "d")])


def _files(tmp_path, *files):
    for i, lines in enumerate(files):
        (tmp_path / f"f{i}.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_bad_lines_are_set_apart(spark, tmp_path):
    path = _files(tmp_path, ["a,b c,d", "1,2,3", '4,"x,y",', "5,6", "7,8,9,10", ",,", "   ", '11,"open,12', '13,"a \\"b\\" c",14'], ["a,b c,d", "null,,é"])
    split = split_csv(spark, path, SMALL)
    assert set(map(tuple, split.rows().collect())) == {("1", "2", "3"), ("4", "x,y", None), (None, None, None), ("13", 'a "b" c', "14"), ("null", None, "é")}
    assert sorted((r.line, r.reason, r.fields) for r in split.rejected().collect()) == [
        ("   ", "empty", 1), ('11,"open,12', "quote", 3), ("5,6", "few", 2), ("7,8,9,10", "many", 4)]
    counts = {(r.outcome, r.reason): r.lines for r in split.counts().collect()}
    assert counts[("header", None)] == 2 and counts[("clean", None)] == 5 and sum(counts.values()) == 11


def test_quarantine_rows_equal_the_plain_reader(spark, sf):
    """A file without bad lines gives the rows that the plain reader gives."""
    from blotter.sources.csv import read_raw_csv, write_csv
    from blotter.sources.standin import raw_incidents
    path = shared_dir(spark, "plain")
    write_csv(raw_incidents(spark, sf, normalize=False), path)
    split, plain = split_csv(spark, path).rows(), read_raw_csv(spark, path)
    assert split.columns == plain.columns
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_another_header_stops_the_split(spark, tmp_path):
    with pytest.raises(ValueError, match="f1.csv"):
        split_csv(spark, _files(tmp_path, ["a,b c,d", "1,2,3"], ["d,b c,a", "1,2,3"]), SMALL)


# --- incremental report -------------------------------------------------------------
def test_replayed_late_and_compacted_batches(spark):
    from blotter.streaming.report import CountState
    schema = T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.LongType())])
    state = CountState(spark, shared_dir(spark, "state"), schema, [["x"], ["x", "y"]])
    assert state.counts().counts("x").collect() == []
    batches = {i: [(f"k{j % 3}" if j % 4 else None, j % 2) for j in range(5 + i)] for i in range(5)}
    frames = {i: spark.createDataFrame(b, schema) for i, b in batches.items()}
    for i in (0, 2, 1, 2):                       # out of order, and one of them twice
        state.fold(frames[i], i)
    assert state.compact(keep=1) == 1 and state.folders()[0] == 1
    for i in (0, 1, 2, 3, 4, 3):                 # 0 and 1 are in the base by now
        state.fold(frames[i], i)
    want = Counter(r[0] for b in batches.values() for r in b)
    check = lambda: {r.x: r["count"] for r in state.counts().counts("x").collect()} == want
    assert check() and state.compact() == 4 and check() and len(state.folders()[1]) == 1
    assert {(r.x, r.y): r["count"] for r in state.counts().counts("x", "y").collect()} == Counter(map(tuple, (r for b in batches.values() for r in b)))


def test_report_state_equals_the_full_report(spark, sf):
    from blotter.plans.eda import eda_report
    from blotter.plans.queries import EXCLUDED_YEAR, MONTH_RANGE, clean
    from blotter.sources import layer
    from blotter.streaming.report import CountState, with_calendar
    rows = with_calendar(layer.with_partition_year(clean(spark, sf)))
    state = CountState(spark, shared_dir(spark, "state"), rows.schema)
    for i in range(2):
        state.fold(rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(2)) == i), i)
    got, want = state.report(MONTH_RANGE, EXCLUDED_YEAR), eda_report(spark, rows, MONTH_RANGE, EXCLUDED_YEAR)
    for name in want:
        assert Counter(map(tuple, got[name].collect())) == Counter(map(tuple, want[name].collect())), name


# --- evaluation ----------------------------------------------------------------------
def test_permuted_keeps_the_values_and_the_other_columns(spark):
    df = spark.createDataFrame([(str(i % 90) if i % 11 else None, f"v{i % 7}" if i % 5 else None, i) for i in range(300)], "k string, v string, n long")
    key = F.coalesce("k", F.lit(""))
    one, again, other = (evaluate.permuted(d, "v", key, s).collect() for d, s in ((df, 1), (df.repartition(7), 1), (df, 2)))
    rows = df.collect()
    assert Counter(r.v for r in one) == Counter(r.v for r in rows) and sorted(r.n for r in one) == list(range(300))
    assert sorted(map(str, one)) == sorted(map(str, again)) != sorted(map(str, other))
    assert sum(a.v != b.v for a, b in zip(sorted(one, key=lambda r: r.n), rows)) > 150


def test_importance_of_inputs_that_matter_and_do_not(spark):
    df = spark.createDataFrame([(str(i), i % 2, i % 5) for i in range(600)], "k string, a long, b long")
    predict = lambda d: d.select((F.col("k").cast("long") % 2).alias("label"), F.col("a").alias("prediction"))
    got = {r.feature: r for r in evaluate.permutation_importance(df, predict, ["a", "b"], F.col("k")).collect()}
    assert got["a"].correct == 600 and 0.4 < got["a"].importance < 0.6 and got["b"].importance == 0


def test_auc_with_ties_and_one_class(spark):
    rng = np.random.default_rng(2)
    rows = [(float(s) if s < 9 else None, bool(p)) for s, p in zip(rng.integers(0, 10, 200) / 1.0, rng.integers(0, 2, 200))]
    pos, neg = ([s for s, p in rows if s is not None and p is x] for x in (True, False))
    got = evaluate.auc(spark.createDataFrame(rows, "score double, positive boolean")).first()
    u = sum(2 if a > b else a == b for a in pos for b in neg)
    assert (got.positives, got.negatives, int(got.twice_u)) == (len(pos), len(neg), u) and got.auc == pytest.approx(u / 2 / len(pos) / len(neg))
    assert evaluate.auc(spark.createDataFrame([(0.5, True)], "score double, positive boolean")).first().auc is None


def test_calibration_bins(spark):
    rows = [(0.0, True), (0.099, False), (0.1, True), (1.0, True), (None, True), (0.95, None)]
    got = {r.bin: (r.rows, r.positives) for r in evaluate.calibration(spark.createDataFrame(rows, "score double, positive boolean")).collect()}
    assert got == {0: (2, 1), 1: (1, 1), 9: (1, 1)}


@pytest.mark.parametrize("percent", [0, 7, 50, 80, 99, 100])
def test_stratified_shares_are_exact(spark, percent):
    rows = [(str(i), "abc"[min(2, i % 7)] if i % 13 else None) for i in range(1500)] + [("x", "tiny")]
    df = spark.createDataFrame(rows, "k string, y string")
    got = evaluate.stratified_flag(df, "y", F.col("k"), percent).collect()
    sizes, train = Counter(r[1] for r in rows), Counter(r.y for r in got if r.in_train)
    assert len(got) == len(rows) and all(train[y] == n * percent // 100 for y, n in sizes.items())
    again = evaluate.stratified_flag(df.repartition(3), "y", F.col("k"), percent).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


# --- itemsets and rules ------------------------------------------------------------------
def test_condensed_itemsets_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    baskets = [frozenset(rng.choice(list("abcdef"), rng.integers(1, 6), replace=False).tolist()) for _ in range(60)]
    freq = {frozenset(c): n for k in range(1, 7) for c in combinations("abcdef", k) if (n := sum(set(c) <= b for b in baskets)) >= 5}
    df = spark.createDataFrame([(list(reversed(sorted(s))), n) for s, n in freq.items()], "items array<string>, freq long")
    for r in itemsets.condensed(df).collect():
        wider = [n for s, n in freq.items() if s > set(r["items"])]
        assert (r.closed, r.maximal, r.above) == (max(wider, default=0) < r.freq, not wider, max(wider, default=0))
    n = len(baskets)
    rules = itemsets.significant_rules(df, n, 0.3).collect()
    assert rules
    for r in rules:
        a, c = set(r.antecedent), set(r.consequent)
        table = np.array([[sum(a <= b and c <= b for b in baskets), sum(a <= b and not c <= b for b in baskets)],
                          [sum(not a <= b and c <= b for b in baskets), sum(not a <= b and not c <= b for b in baskets)]], dtype=float)
        want = table.sum(1)[:, None] * table.sum(0)[None, :] / n
        if (want > 0).all():
            assert r.chi2 == pytest.approx(((table - want) ** 2 / want).sum()) and r.significant == (r.chi2 >= itemsets.CRITICAL)


@pytest.mark.parametrize("broadcast_rules", [10, 0])
def test_rules_are_applied_the_same_way_by_either_join(spark, broadcast_rules):
    rules = [(["a"], ["b"]), (["a", "b"], ["c"]), (["d"], ["a"]), (["c", "d"], ["e"]), (["z"], ["a"])]
    baskets = [["a"], ["b", "a"], ["d", "c"], [], None, ["a", "b", "c"], ["q"]] * 3
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "id long, items array<string>")
    got = {r.id: r.prediction for r in itemsets.predict(spark.createDataFrame(rules, "antecedent array<string>, consequent array<string>"), df,
                                                          broadcast_rules=broadcast_rules).collect()}
    for i, b in enumerate(baskets):
        assert got[i] == sorted({c for a, cs in rules if set(a) <= set(b or []) for c in cs} - set(b or []))


# --- repair -----------------------------------------------------------------------------------
def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_near_pairs_lose_none(spark, most):
    rng = np.random.default_rng(most)
    word = lambda: "".join(rng.choice(list("abc"), rng.integers(0, 9)))
    left, right = {word() for _ in range(120)} | {"", "aaaaaaaa"}, {word() for _ in range(120)} | {"", "aaaaaaa"}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs] + [(None,)], "text string")
    got = {(r.a, r.b): r.distance for r in repair.near_pairs(frame(left), frame(right), most).collect()}
    assert got == {(a, b): d for a in left for b in right if (d := _edits(a, b)) <= most}


# --- clustered layer, heavy hitters ------------------------------------------------------------
def test_clustered_layer_skips_files(spark):
    df = spark.range(40_000).selectExpr("pmod(id * 7919, 365) as day", "concat('area', pmod(id * 104729, 21)) as area",
                                        "if(id % 3 = 0, 'hot', concat('c', id % 50)) as crime", "if(id % 997 = 0, null, id) as x")
    path = shared_dir(spark, "clustered")
    zlayer.write_clustered(df, path, ["day", "area", "x"], files=64)
    got = zlayer.Clustered(spark, path, df.schema)
    files, rows = got.manifest.count(), got.manifest.agg(F.sum("rows")).first()[0]
    assert rows == 40_000 and files >= 40
    for conditions, where in (({"area": "area3", "day": (100, 130)}, "area = 'area3' and day >= 100 and day < 130"),
                              ({"day": (None, 20)}, "day < 20"), ({"x": 17}, "x = 17"), ({"day": (360, None), "area": "area1"}, "day >= 360 and area = 'area1'"),
                              ({"area": "nowhere"}, "false")):
        found, want = got.read(**conditions), df.filter(where)
        assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0
    assert len(got.files(area="area3", day=(100, 130))) <= files / 4
    assert got.files(area="nowhere") == []


def test_top_values_are_exact_with_few_counters(spark):
    rows = [(f"h{i % 12}",) for i in range(9000)] + [(f"u{i}",) for i in range(3000)] + [(None,)] * 50
    rows += [(f"h{i}",) for i in range(12) for _ in range(10 * i)]
    df = spark.createDataFrame(rows, "v string").repartition(6)
    want = sorted(Counter(r[0] for r in rows if r[0]).items(), key=lambda x: (-x[1], x[0]))[:5]
    assert heavy.candidates(df, "v", 5, capacity=60).count() <= 6 * 60
    assert [tuple(r) for r in heavy.top_values(df, "v", 5, capacity=60).collect()] == want


def test_top_values_of_unique_keys(spark):
    """Nothing stands out: the summaries stay at their capacity, prove nothing, and the plain count answers."""
    df = spark.range(5000).selectExpr("lpad(cast(id as string), 5, '0') as v").repartition(4)
    per_task = heavy.summaries(df, "v", capacity=50).filter("value is not null").count()
    assert per_task <= 4 * 50
    assert heavy.candidates(df, "v", 3, capacity=50) is None
    assert [r.v for r in heavy.top_values(df, "v", 3, capacity=50).collect()] == ["00000", "00001", "00002"]
    assert heavy.top_values(df.limit(0), "v", 3).collect() == []
