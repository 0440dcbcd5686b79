"""Baskets, frequent itemsets, association rules and rule application.

Mining is Spark ML's distributed FP-growth.  Rules are applied by
:func:`blotter.operators.itemsets.predict`, which counts them first: few are
broadcast, more meet the baskets by a join.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.operators import itemsets

ITEMS = "items"
#: Baskets that one mining task reads, at most about.
BASKETS_PER_TASK = 250_000
#: Frequent items up to which the others are taken out of the baskets before mining.
MAX_KEPT_ITEMS = 10_000


def basket(columns: list[str]) -> Column:
    """The non-NULL values of ``columns`` as one array, repeats removed (FP-growth needs unique items)."""
    arr = F.array(*[F.col(c) for c in columns])
    return F.array_distinct(F.filter(arr, lambda x: x.isNotNull()))


def items_text(c: str | Column) -> Column:
    """An item array as sorted, comma-joined text (order-free comparison and display)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(col), ",")


def frequent_part(baskets: DataFrame, items_col: str, need: int) -> DataFrame:
    """The baskets with their frequent items only, each of them kept, empty or not.

    An itemset with an item of fewer than ``need`` baskets is not frequent, so mining finds the same.  The frequent items
    are at most the items of all baskets / ``need``; above ``MAX_KEPT_ITEMS`` nothing is taken out.
    A basket that names an item twice stays as it is: FP-growth refuses it.
    """
    seen = baskets.select(F.explode(items_col).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    held = [r["item"] for r in seen.filter((F.col("n") >= need) & F.col("item").isNotNull()).select("item").limit(MAX_KEPT_ITEMS + 1).collect()]
    if len(held) > MAX_KEPT_ITEMS:
        return baskets
    items = F.col(items_col)
    kept = F.filter(items, lambda x: x.isNull() | x.isin(held))
    return baskets.select(F.when(F.size(F.array_distinct(items)) == F.size(items), kept).otherwise(items).alias(items_col))


def mine(baskets: DataFrame, min_support: float, min_confidence: float,
         items_col: str = ITEMS, num_partitions: int | None = None,
         baskets_per_task: int = BASKETS_PER_TASK) -> FPGrowthModel:
    """Fit FP-growth; its itemsets stay persisted until :func:`release`.

    The baskets are dealt over tasks by their number and kept as columns while the mining reads them;
    FP-growth would otherwise keep them as objects, in as few blocks as the input has partitions.
    """
    fp = FPGrowth(itemsCol=items_col, minSupport=min_support, minConfidence=min_confidence)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    known = baskets.select(items_col).filter(F.col(items_col).isNotNull())
    n = known.count()
    rows = frequent_part(known, items_col, math.ceil(min_support * n))
    if n > baskets_per_task:
        tasks = max(math.ceil(n / baskets_per_task), baskets.sparkSession.sparkContext.defaultParallelism)
        rows = rows.repartition(tasks)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fp.fit(rows)
        # The model's itemsets are a lazy plan over the input; itemsets, rules and
        # rule application would each re-run the mining, so keep them once (memory,
        # then disk); a lost block is recomputed from lineage.
        model.freqItemsets.persist(StorageLevel.MEMORY_AND_DISK).count()
    finally:
        rows.unpersist()
    return model


def freq_itemsets(model: FPGrowthModel) -> DataFrame:
    """(``items`` sorted text, ``size`` int, ``freq`` bigint)."""
    fi = model.freqItemsets
    return fi.select(items_text("items").alias("items"), F.size("items").alias("size"),
                     F.col("freq").cast("long").alias("freq"))


def assoc_rules(model: FPGrowthModel, digits: int = 6) -> DataFrame:
    """(``antecedent``, ``consequent`` sorted text, ``confidence``, ``lift``, ``support`` rounded)."""
    r = model.associationRules
    return r.select(
        items_text("antecedent").alias("antecedent"),
        items_text("consequent").alias("consequent"),
        F.round("confidence", digits).alias("confidence"),
        F.round("lift", digits).alias("lift"),
        F.round("support", digits).alias("support"),
    )


def apply_rules(model: FPGrowthModel, baskets: DataFrame) -> DataFrame:
    """Adds ``prediction``: consequents of every rule whose antecedent the basket holds,
    minus items it already holds; a NULL basket predicts ``[]``."""
    return itemsets.predict(model.associationRules, baskets, model.getItemsCol())


def release(model: FPGrowthModel) -> None:
    """Drop the persisted itemsets."""
    model.freqItemsets.unpersist()
