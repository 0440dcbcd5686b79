"""The exploratory report kept up to date as incident files arrive.

The report's tables are sums of counts, so they can be kept as a state: each
micro-batch is reduced to its GROUPING SETS counts (the same single pass as the
full report) and written to a folder named after its batch id.  The report is
the sum over the folders.

* Idempotent: a batch that runs again overwrites its own folder.
* Late or out-of-order batches add their counts like any other one.
* Bounded: :meth:`CountState.compact` adds up the folders below a batch id
  into one base; a base is used only when its write has been committed, and a batch that a
  base holds already is not folded a second time.

The state's size is that of the vocabularies, not of the incidents.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from blotter.operators import trends
from blotter.operators.recode import CheckedDim
from blotter.plans.eda import AREA_GROUPS, REPORT_SETS, area_names
from blotter.sources.dims import weekday_dim
from blotter.sources.layer import PARTITION_COLUMN
from blotter.streaming.ingest import clean_stream

#: The report's grouping sets and those of its calendar tables.
STATE_SETS = [*REPORT_SETS, [PARTITION_COLUMN], ["occ_month"]]


def with_calendar(clean: DataFrame) -> DataFrame:
    """The cleaned rows with weekday, and the month as ``yyyy-MM``: a range of whole months can be summed from it."""
    date = trends._date(clean, "date_occ")
    return clean.withColumn("day_of_week", trends.day_name(date)).withColumn("occ_month", F.date_format(date, "yyyy-MM"))


class StoredCounts(trends.GroupedCounts):
    """The tables of :class:`trends.GroupedCounts` over counts that are stored already."""

    def __init__(self, table: DataFrame, sets: list[list[str]]):
        self.columns = list(dict.fromkeys(c for s in sets for c in s))
        self.sets = [list(s) for s in sets]
        self.table = table


class CountState:
    """Counts of several groupings as folders ``batch=<id>`` and ``base=<id>`` below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, sets: list[list[str]] = STATE_SETS):
        self.spark, self.path, self.sets = spark, path.rstrip("/"), sets
        self.columns = list(dict.fromkeys(c for s in sets for c in s))
        kinds = {f.name: f.dataType for f in schema.fields}
        self.schema = T.StructType([*(T.StructField(c, kinds[c]) for c in self.columns), T.StructField(trends.COUNT, T.LongType()),
                                    T.StructField("__gid", T.LongType())])

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root, jvm.org.apache.hadoop.fs.Path

    def folders(self) -> tuple[int, list[str]]:
        """(the last batch of the base in use, -1 if there is none; the folders that make up the state)."""
        fs, root, path = self._fs()
        found: dict[str, list[int]] = {"base": [], "batch": []}
        if fs.exists(root):
            for status in fs.listStatus(root):
                m = re.fullmatch(r"(base|batch)=(\d+)", status.getPath().getName())
                if m and fs.exists(path(status.getPath(), "_SUCCESS")):
                    found[m[1]].append(int(m[2]))
        base = max(found["base"], default=-1)
        used = [f"{self.path}/base={base}"] if base >= 0 else []
        return base, used + [f"{self.path}/batch={b}" for b in sorted(found["batch"]) if b > base]

    def fold(self, rows: DataFrame, batch_id: int) -> None:
        """Add one batch, or write the same batch anew."""
        if batch_id <= self.folders()[0]:
            return
        grouped = rows.groupingSets([[F.col(c) for c in s] for s in self.sets], *[F.col(c) for c in self.columns])
        counts = grouped.agg(F.count(F.lit(1)).alias(trends.COUNT), F.grouping_id().cast("long").alias("__gid"))
        counts.select(*self.schema.names).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def _summed(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        parts = self.spark.read.schema(self.schema).parquet(*folders)
        return parts.groupBy("__gid", *self.columns).agg(F.sum(trends.COUNT).alias(trends.COUNT))

    def compact(self, keep: int = 0) -> int:
        """Sum all folders but the last ``keep`` batches into a new base; the last batch that it holds (-1: none)."""
        base, used = self.folders()
        batches = [f for f in used if "/batch=" in f]
        done = batches[:len(batches) - keep] if keep else batches
        if not done:
            return base
        last = int(done[-1].rsplit("=", 1)[1])
        merged = [f for f in used if "/base=" in f] + done
        self._summed(merged).select(*self.schema.names).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base={last}")
        fs, _, path = self._fs()
        for folder in merged:           # readers use the new base from now on
            fs.delete(path(folder), True)
        return last

    def counts(self) -> StoredCounts:
        return StoredCounts(self._summed(self.folders()[1]), self.sets)

    def report(self, month_range: tuple[str, str], exclude_year: int | None = None, k: int = 10,
               groups: list[str] = AREA_GROUPS) -> dict[str, DataFrame]:
        """The tables of :func:`blotter.plans.eda.eda_report`; the ends of ``month_range`` are first days of months."""
        if any(not d.endswith("-01") for d in month_range):
            raise ValueError(f"the state holds whole months, not {month_range}")
        g = self.counts()
        year = g.counts(PARTITION_COLUMN).withColumnRenamed(PARTITION_COLUMN, "year")
        if exclude_year is not None:
            year = year.filter(F.col("year").isNotNull() & (F.col("year") != exclude_year))
        start, end = (d[:7] for d in month_range)
        months = g.counts("occ_month").filter((F.col("occ_month") >= start) & (F.col("occ_month") < end))
        month = months.groupBy(F.substring("occ_month", 6, 2).cast("int").alias("month")).agg(F.sum(trends.COUNT).alias(trends.COUNT))
        out = {
            "top_crime": g.top_k("crm_cd_desc", k), "top_weapon": g.top_k("weapon_desc", k), "top_area": g.top_k("area_name", k),
            "top_descent": g.top_k("vict_descent", k), "count_by_sex": g.counts("vict_sex", name="crime_count"),
            "age_dist": g.ranked("vict_age"), "age_sex_dist": g.ranked("vict_age", "vict_sex"),
            "year_trend": trends._small_sorted(year, "year"), "month_trend": trends._small_sorted(month, "month"),
            "weekday_trend": g.weekday(weekday_dim(self.spark)), "area_by_group_wide": g.area_wide(groups),
        }
        return out | {name: g.by_area(v) for v, name in area_names(groups).items()}


def start_report(spark: SparkSession, source_dir: str, state_path: str, checkpoint_location: str, dim: DataFrame | CheckedDim,
                 max_files_per_trigger: int | None = None, compact_every: int = 50) -> tuple[StreamingQuery, CountState]:
    """Fold every incident file present below ``source_dir`` into the state, then stop."""
    rows = with_calendar(clean_stream(spark, source_dir, dim, max_files_per_trigger))
    state = CountState(spark, state_path, rows.schema)

    def fold(batch: DataFrame, batch_id: int) -> None:
        state.fold(batch, batch_id)
        if batch_id % compact_every == compact_every - 1:
            state.compact(keep=1)       # the newest batch may still run again

    query = rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start()
    return query, state
