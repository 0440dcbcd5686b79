"""Condensed itemsets, significant rules, and rule application that fits any number of rules.

An itemset is *closed* if no larger itemset holds it in as many baskets, and
*maximal* if no larger one is frequent at all.  Support only falls as items
are added, so the supersets with one item more decide both: each itemset of
``n`` items sends its support to its ``n`` subsets of ``n - 1``, which is one
aggregation and one join over the itemsets, whatever their number.

A rule's chi-square statistic is computed from the four whole counts of its
2 x 2 table (baskets with and without antecedent and consequent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that are broadcast to the baskets at most.
BROADCAST_RULES = 10_000
#: Chi-square with one degree of freedom at a chance of one in a thousand.
CRITICAL = 10.828


def condensed(itemsets: DataFrame) -> DataFrame:
    """(items, freq, above, closed, maximal) of all frequent ``itemsets`` (items array, freq long).

    ``above``: the largest support of an itemset with one item more (0: none is frequent).
    """
    sets = itemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq"))
    items = F.col("items")
    subsets = F.transform(items, lambda x: F.filter(items, lambda y: y != x))
    above = sets.filter(F.size("items") > 1).select(F.explode(subsets).alias("items"), "freq") \
        .groupBy("items").agg(F.max("freq").alias("above"))
    out = sets.join(above, "items", "left").withColumn("above", F.coalesce("above", F.lit(0).cast("long")))
    return out.select("items", "freq", "above", (F.col("above") < F.col("freq")).alias("closed"), (F.col("above") == 0).alias("maximal"))


def chi_square(n: Column, both: Column, left: Column, right: Column) -> Column:
    """Of ``n`` baskets, ``left`` with the antecedent, ``right`` with the consequent, ``both`` with both; NULL if a margin is empty."""
    n, both, left, right = (c.cast("double") for c in (n, both, left, right))
    margins = left * right * (n - left) * (n - right)
    return F.when(margins > 0, n * (n * both - left * right) * (n * both - left * right) / margins)


def significant_rules(itemsets: DataFrame, n: int, min_confidence: float, critical: float = CRITICAL) -> DataFrame:
    """Rules with one consequent out of all frequent ``itemsets`` of ``n`` baskets, with counts and chi-square.

    (antecedent, consequent arrays, n_both, n_antecedent, n_consequent, confidence, chi2, significant).
    All subsets of a frequent itemset are frequent, so every count is in the table.
    """
    sets = itemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq"))
    items = F.col("items")
    split = F.transform(items, lambda x: F.struct(F.filter(items, lambda y: y != x).alias("antecedent"), F.array(x).alias("consequent")))
    rules = sets.filter(F.size("items") > 1).select(F.explode(split).alias("r"), F.col("freq").alias("n_both")).select("r.*", "n_both")
    of = lambda side: sets.select(F.col("items").alias(side), F.col("freq").alias(f"n_{side}"))
    rules = rules.join(of("antecedent"), "antecedent").join(of("consequent"), "consequent")
    confidence = F.col("n_both") / F.col("n_antecedent")
    chi2 = chi_square(F.lit(n), F.col("n_both"), F.col("n_antecedent"), F.col("n_consequent"))
    return rules.filter(confidence >= min_confidence).select(
        "antecedent", "consequent", "n_both", "n_antecedent", "n_consequent", confidence.alias("confidence"), chi2.alias("chi2"),
        F.coalesce(chi2 >= critical, F.lit(False)).alias("significant"))


def predict(rules: DataFrame, baskets: DataFrame, items_col: str = "items", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``baskets`` with ``prediction``: the consequents of all rules whose antecedent a basket holds, less its own items, sorted.

    ``rules``: antecedent, consequent (arrays).  They are counted first: up to ``broadcast_rules`` are brought
    together to one row and broadcast.  More of them meet the different baskets by the rarest item of their antecedent, and the
    other items are compared where they meet.
    """
    own = F.array_sort(F.array_distinct(F.coalesce(F.col(items_col), F.array().cast("array<string>"))))
    given = baskets.withColumn("__basket", own)
    few = rules.select("antecedent", "consequent").limit(broadcast_rules + 1).count() <= broadcast_rules
    basket = F.col("__basket")
    if few:
        held = rules.agg(F.collect_list(F.struct("antecedent", "consequent")).alias("__rules"))
        fired = F.filter("__rules", lambda r: F.size(F.array_except(r["antecedent"], basket)) == 0)
        found = F.flatten(F.transform(fired, lambda r: r["consequent"]))
        one = F.lit(1).alias("__one")
        return given.select("*", one).join(F.broadcast(held.select("*", one)), "__one") \
            .withColumn("prediction", F.array_sort(F.array_except(found, basket))).drop("__basket", "__rules", "__one")
    kinds = given.select("__basket").distinct()
    items = kinds.select("__basket", F.explode("__basket").alias("__item"))
    seen = items.groupBy("__item").agg(F.count(F.lit(1)).alias("__n"))
    rarest = rules.select("antecedent", "consequent", F.explode("antecedent").alias("__item")).join(seen, "__item") \
        .groupBy("antecedent", "consequent").agg(F.min_by("__item", F.struct("__n", "__item")).alias("__item"))
    met = items.join(rarest, "__item").filter(F.size(F.array_except("antecedent", basket)) == 0)
    answers = met.groupBy("__basket").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("consequent")))).alias("__all"))
    answered = given.join(answers, "__basket", "left")
    return answered.withColumn("prediction", F.coalesce(F.array_except("__all", basket), F.array().cast("array<string>"))).drop("__basket", "__all")
