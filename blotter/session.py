"""Session helpers: a local session for tests/bench and the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Setting under which Spark removes a query's shuffle files when the query ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "blotter", max_partition_mb: int | None = None,
                  event_log_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench (never used inside operators).

    ``max_partition_mb`` sizes file splits; on a cluster the default 128 MB is
    right, locally a smaller split keeps every core busy on small files.
    """
    n = (os.cpu_count() or 8) if cores == "*" else int(cores)
    parts = shuffle_partitions or max(8, 2 * int(n))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if max_partition_mb:
        builder = builder.config("spark.sql.files.maxPartitionBytes", f"{max_partition_mb}m")
    if event_log_dir:
        os.makedirs(event_log_dir, exist_ok=True)
        builder = (builder.config("spark.eventLog.enabled", "true")
                          .config("spark.eventLog.dir", event_log_dir))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the cluster's shared folder (``spark.checkpoint.dir``).

    Intermediate tables and lineage cuts go there, never to a machine-local
    temp folder.  Only when the session names no such folder (local tests)
    is one created and registered.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = _local_folder(spark)
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as soon as each is done: what reads the written table doesn't need them."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, and a cut of its lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _local_folder(spark: SparkSession) -> str:
    """A temp folder for a local session; on a cluster the executors would each see their own."""
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="blotter-ckpt-")


def cluster_conf(input_bytes: int, total_cores: int, split_mb: int = 512,
                 bytes_per_shuffle_partition: int = 2 * 1024 ** 3,
                 max_shuffle_partitions: int = 50_000) -> dict[str, str]:
    """Settings sized to the input, for a cluster session (``SparkSession.builder.config(map=...)``).

    * file splits of ``split_mb`` (100 TB -> ~200k scan tasks, many waves on any cluster);
    * AQE on; the initial shuffle partition count is input / 2 GB, at least 2 per core
      and at most ``max_shuffle_partitions``: shuffle blocks grow as map tasks x
      reduce partitions, so the count is capped and AQE does the rest -- it
      coalesces the tiny outputs of the group-bys (partial aggregation shrinks them
      by orders of magnitude) and splits large or skewed partitions of the layer
      write (REBALANCE) and of shuffle joins to the advisory size;
    * skew joins split partitions over 4x the median (a hot category holding a
      third of all rows);
    * broadcast threshold at dictionary scale (64 MB): recode dictionaries and the
      rule set are bounded and checked, fact tables never qualify.
    """
    mb = 1024 * 1024
    parts = min(max_shuffle_partitions, max(2 * total_cores, input_bytes // bytes_per_shuffle_partition))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.files.maxPartitionBytes": f"{split_mb * mb}",
        "spark.sql.autoBroadcastJoinThreshold": str(64 * mb),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.csv.parser.columnPruning.enabled": "true",
    }


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total bytes below ``path`` on any Hadoop file system (one metadata call, no data read)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(hpath).getLength())


def size_to_input(spark: SparkSession, path: str) -> dict[str, str]:
    """Apply :func:`cluster_conf` for the input at ``path`` to the running session (SQL settings only)."""
    conf = cluster_conf(input_bytes(spark, path), spark.sparkContext.defaultParallelism)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
