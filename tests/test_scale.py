"""Work that is done once, and blocks that follow the number of rows."""
import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from blotter.operators import classify, patterns
from blotter.session import shared_dir
from blotter.sources import zlayer
from blotter.sources.standin import raw_incidents


@pytest.fixture
def counted(spark):
    """(a column as it is, the number of rows for which it was computed)."""
    seen = spark.sparkContext.accumulator(0)

    def one(x):
        seen.add(1)
        return x
    return F.udf(one, "string").asNondeterministic(), seen


def test_clustered_rows_are_computed_once(spark, counted):
    passed, seen = counted
    df = spark.range(2000).select(passed(F.col("id").cast("string")).alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    path = shared_dir(spark, "clustered")
    zlayer.write_clustered(df, path, ["a", "b"], files=4)
    assert seen.value == 2000
    assert zlayer.Clustered(spark, path, df.schema).read(b="3").count() == sum(i % 7 == 3 for i in range(2000))


def test_rule_baskets_are_computed_once(spark, counted):
    from blotter.plans.rules import mine_rules
    passed, seen = counted
    df = spark.range(1000).select("id", F.array(passed(F.concat(F.lit("a"), (F.col("id") % 2).cast("string"))), F.lit("b")).alias("items"))
    mined = mine_rules(df, "id")
    assert {r.items for r in mined.itemsets().collect()} == {"a0", "a1", "b", "a0,b", "a1,b"}
    assert mined.rules().count() > 0 and mined.predictions().count() == mined.test.count()
    assert seen.value == 1000


def test_mining_deals_baskets_by_their_number(spark, monkeypatch):
    rows = [[f"{c}{i % n}" for c, n in zip("abc", (2, 3, 40))] for i in range(1, 481)] + [[], [None, "a0"]]
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], "items array<string>").coalesce(1)
    fits, fit = [], patterns.FPGrowth.fit
    monkeypatch.setattr(patterns.FPGrowth, "fit", lambda self, d: fits.append((d.rdd.getNumPartitions(), d.storageLevel.useMemory)) or fit(self, d))
    model = patterns.mine(df, 0.15, 0.5, baskets_per_task=30)
    assert fits[0][0] >= 16 and fits[0][1]
    want = Counter(",".join(s) for r in rows for k in (1, 2, 3) for s in itertools.combinations(sorted(x for x in r if x), k))
    assert {r["items"]: r.freq for r in patterns.freq_itemsets(model).collect()} == {k: n for k, n in want.items() if n >= 0.15 * len(rows)}
    left = patterns.frequent_part(df.filter("items is not null"), "items", 100)
    assert left.count() == len(rows) and {x for r in left.collect() for x in r["items"]} == {"a0", "a1", "b0", "b1", "b2", None}


def test_an_item_named_twice_is_still_refused(spark):
    with pytest.raises(Exception, match="unique"):
        patterns.mine(spark.createDataFrame([(["a", "b"],), (["a", "z", "z"],)], "items array<string>"), 0.9, 0.5)


def test_training_rows_are_dealt_by_their_width(spark, sf, monkeypatch):
    assert classify.training_tasks(0, 100) == 1
    assert classify.training_tasks(1000, 50, 4000) == 100 and classify.training_tasks(2000, 200, 4000) == 500
    parts = []
    fit = classify.RandomForestClassifier.fit
    monkeypatch.setattr(classify, "training_tasks", lambda rows, slots: 2 * spark.sparkContext.defaultParallelism if rows and slots > 64 else 1)
    monkeypatch.setattr(classify.RandomForestClassifier, "fit", lambda self, d: parts.append(d.rdd.getNumPartitions()) or fit(self, d))
    from blotter.plans.classification import train_classifier
    got = train_classifier(raw_incidents(spark, sf), classify.row_key("dr_no"), num_trees=2)
    assert parts == [2 * spark.sparkContext.defaultParallelism]
    assert got.accuracy().first().scored > 0


@pytest.mark.parametrize("name", ["clean_stream_roundtrip", "incremental_report", "assemble_nine"])
def test_the_raw_rows_are_built_once(spark, sf, counted, monkeypatch, name):
    import __spark_entry__ as entry
    from blotter.plans import deep_queries, queries
    passed, seen = counted

    def build(*args, normalize=True):
        raw = raw_incidents(*args, normalize=normalize)
        key = "dr_no" if normalize else "DR_NO"
        return raw.withColumn(key, passed(key))
    monkeypatch.setattr(queries, "raw_incidents", build)
    monkeypatch.setattr(deep_queries, "raw_incidents", build)
    assert entry.queries()[name](spark, sf).count() > 0
    assert seen.value == raw_incidents(spark, sf).count()


def test_dates_are_parsed_once(spark, sf):
    from blotter.plans import queries
    from blotter.sources import layer
    df = layer.with_partition_year(queries.clean(spark, sf))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp") <= 2


def test_field_counts_of_odd_lines(spark, tmp_path):
    from pyspark.sql import types as T

    from blotter.sources.quarantine import split_csv
    lines = ["a,b,c", "\t \x0b", ",,,", '"x,y",2', '"x ""q"" y",2,3', '"', "1,2,3", ",,"]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    split = split_csv(spark, str(tmp_path), T.StructType([T.StructField(c, T.StringType()) for c in "abc"]))
    assert sorted((r.reason, r.fields) for r in split.rejected().collect()) == [("empty", 1), ("few", 2), ("many", 4), ("quote", 1)]
    assert split.rows().count() == 3


def test_a_raw_file_is_written_in_turns_and_packed(spark, sf, tmp_path, monkeypatch):
    from blotter.plans import queries
    from blotter.sources import csv, standin
    assert len(standin.in_turns(raw_incidents(spark, sf, normalize=False), sf)) == 1
    monkeypatch.setattr(standin, "ONE_TURN", 1)
    monkeypatch.setattr(csv, "ROWS_PER_FILE", 100)
    raw = raw_incidents(spark, sf, normalize=False)
    shares = standin.in_turns(raw, sf)
    assert len(shares) == standin.TURNS
    plans = [s._jdf.queryExecution().optimizedPlan().toString() for s in shares]
    lowest = [next(line for line in p.splitlines() if "xxhash64" in line) for p in plans]
    assert all("l_suppkey" in line and p.splitlines()[p.splitlines().index(line) + 1].lstrip(" :+-").startswith("Relation") for p, line in zip(plans, lowest))
    got = queries.q_csv_roundtrip(spark, sf)
    assert got.count() == raw.count()
    want = raw.toDF(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    files = got.inputFiles()
    assert len(files) >= raw.count() / 100 and all(f.endswith(".csv.gz") for f in files)


def test_shares_lose_no_row_where_keys_are_null(spark, tmp_path, monkeypatch):
    from blotter.sources import standin
    monkeypatch.setattr(standin, "ONE_TURN", 0)
    spark.range(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 2), ("", 3), ("7", 4)], "Mocodes string, n int")
    got = [r for s in standin.in_turns(rows, str(tmp_path)) for r in s.collect()]
    assert Counter(got) == Counter(rows.collect())


@pytest.mark.parametrize("name", ["clean_stream_roundtrip", "incremental_report"])
def test_landed_parts_are_packed_and_whole_in_turns(spark, sf, monkeypatch, name):
    import __spark_entry__ as entry
    from blotter.plans import deep_queries, queries
    from blotter.sources import csv, standin
    query = entry.queries()[name]
    want = Counter(query(spark, sf).collect())
    files, land = [], csv.land_parts

    def landed(df, path, part):
        land(df, path, part)
        files.append(spark.read.text(path).inputFiles())
    monkeypatch.setattr(queries, "land_parts", landed)
    monkeypatch.setattr(deep_queries, "land_parts", landed)
    monkeypatch.setattr(standin, "ONE_TURN", 1)
    assert Counter(query(spark, sf).collect()) == want
    assert len(files) == standin.TURNS and len(files[0]) < len(files[-1])
    assert all(f.endswith(".csv.gz") for f in files[-1])


def test_lineitem_is_dealt_twice_for_a_file(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = raw_incidents(spark, sf, normalize=False)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("Exchange hashpartitioning(" in line for line in lines) == 6       # lineitem 2, part, orders 2, customer
    assert sum("Exchange hashpartitioning(l_" in line for line in lines) == 2
