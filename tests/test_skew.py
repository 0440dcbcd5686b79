"""Hot keys: one value holding a large share of all rows."""
import os

from pyspark.sql import functions as F

from blotter.operators.recode import recode
from blotter.session import shared_dir
from blotter.sources import layer
from blotter.sources.dims import recode_dim


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_layer_write_splits_a_hot_year(spark):
    # 90 % of the rows in one year: REBALANCE lets AQE split that year into several tasks and files
    n = 200_000
    df = spark.range(0, n).select(
        F.col("id").cast("string").alias("dr_no"),
        F.when(F.col("id") % 10 == 0, F.lit("06-15-2019")).otherwise(F.lit("03-01-2020")).alias("date_occ"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    path = shared_dir(spark, "hot-year")
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    _with_conf(spark, conf, lambda: layer.write_layer(df.repartition(8), path))
    local = path.replace("file:", "")
    hot = [f for f in os.listdir(f"{local}/occ_year=2020") if f.endswith(".parquet")]
    assert len(hot) > 1
    back = layer.read_layer(spark, path)
    assert back.count() == n
    assert back.filter("occ_year = 2020").count() == n - n // 10


def test_recode_shuffle_path_with_hot_category(spark):
    n = 30_000
    facts = spark.range(0, n).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("ASSAULT")).otherwise(
            F.concat(F.lit("C"), (F.col("id") % 97).cast("string"))).alias("c"))
    dim = recode_dim(spark, [("crime", "ASSAULT", "Assault")] +
                     [("crime", f"C{i}", f"G{i % 5}") for i in range(0, 97, 2)])

    def run():
        out = recode(facts, "c", dim, "crime", max_broadcast_rows=0)
        plan = out._jdf.queryExecution().executedPlan().toString()
        counts = {r.c: r["count"] for r in out.groupBy("c").count().collect()}
        return plan, counts

    plan, counts = _with_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}, run)
    assert "SortMergeJoin" in plan
    assert counts["Assault"] == n // 3 + (1 if n % 3 else 0)
    assert sum(counts.values()) == n
    assert "C1" in counts and "C0" not in counts     # odd codes unmapped, even codes grouped
