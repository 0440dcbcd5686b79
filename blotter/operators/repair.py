"""Repair suggestions for values that no dictionary entry covers: near entries by edit distance.

A q-gram prefix-filter join.  An edit changes at most ``Q`` q-grams of a text, so of
two texts within ``most`` edits, the longer one of which has ``G`` grams, at least ``G - most * Q`` grams are common.
If all grams are put in one order (rarest first), the first ``most * Q + 1`` grams of both must then share one:
only these are joined, so pairs that have nothing rare in common never meet.  Texts so short that
they need not share any gram are joined by their lengths instead.  Candidates are verified by their edit distance, so
the result equals a comparison of all pairs, without making them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.session import stored

Q = 2
#: Edits between a value and its suggestion, at most.
MOST = 2


def _grams(text: Column) -> Column:
    """The q-grams of a text, repeated ones numbered, so that they are a set; a text shorter than ``Q`` has none."""
    n = F.length(text) - (Q - 1)
    raw = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(Q)))) \
        .otherwise(F.array().cast("array<string>"))
    return F.transform(raw, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(raw, 1, i + 1), lambda x: x == g)).alias("nth")))


def near_pairs(left: DataFrame, right: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b, distance) for all texts ``left.text`` and ``right.text`` within ``most`` edits of one another."""
    need = most * Q + 1
    texts = left.select("text", F.lit(0).alias("side")).unionByName(right.select("text", F.lit(1).alias("side"))) \
        .filter("text is not null").distinct()
    grams = stored(texts.select("text", "side", F.explode_outer(_grams(F.col("text"))).alias("gram")), "grams")
    often = grams.filter("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ordered = grams.join(often, "gram", "left").groupBy("text", "side") \
        .agg(F.array_sort(F.collect_list(F.when(F.col("gram").isNotNull(), F.struct("n", "gram")))).alias("all"))
    first = F.transform(F.slice("all", 1, need), lambda x: F.concat(F.lit("g"), x["gram"]["nth"].cast("string"), F.lit(":"), x["gram"]["g"]))
    # A text of so few grams may share none with one that has as few: these meet by length.
    short = F.when(F.size("all") <= most * Q, F.transform(
        F.when(F.col("side") == 0, F.sequence(F.greatest(F.length("text") - most, F.lit(0)), F.length("text") + most)).otherwise(F.array(F.length("text"))),
        lambda n: F.concat(F.lit("l"), n.cast("string")))).otherwise(F.array().cast("array<string>"))
    keyed = stored(ordered.select("text", "side", F.explode(F.concat(first, short)).alias("key")), "gram-keys")
    one = keyed.filter("side = 0").select("key", F.col("text").alias("a"))
    two = keyed.filter("side = 1").select("key", F.col("text").alias("b"))
    near = F.abs(F.length("a") - F.length("b")) <= most
    pairs = one.join(two, "key").filter(near).select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", most)).filter(F.col("distance") >= 0)


def suggestions(unmapped: DataFrame, keys: DataFrame, most: int = MOST) -> DataFrame:
    """(domain, value, n, suggestion, distance) for unmapped values (domain, value, n) and dictionary keys (domain, raw).

    All nearest entries of the value's own domain; values without any near entry are left out.  Letters are compared
    as if they were capital, as the codes are.
    """
    tagged = lambda df, c: df.filter(F.col(c).isNotNull()).select(F.concat("domain", F.lit("\u0001"), F.upper(c)).alias("text"))
    pairs = near_pairs(tagged(unmapped, "value"), tagged(keys, "raw"), most)
    same = F.split_part("a", F.lit("\u0001"), F.lit(1)) == F.split_part("b", F.lit("\u0001"), F.lit(1))
    pairs = pairs.filter(same)
    values = unmapped.select("domain", "value", "n", F.concat("domain", F.lit("\u0001"), F.upper("value")).alias("a"))
    entries = keys.select("raw", F.concat("domain", F.lit("\u0001"), F.upper("raw")).alias("b")).distinct()
    found = values.join(pairs, "a").join(entries, "b")
    least = found.groupBy("domain", "value").agg(F.min("distance").alias("distance"))
    return found.join(least, ["domain", "value", "distance"]).select("domain", "value", "n", F.col("raw").alias("suggestion"), "distance")
