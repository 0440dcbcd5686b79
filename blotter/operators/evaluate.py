"""Evaluation of scored rows beyond accuracy: permutation importance, exact AUC, calibration bins, exact stratified splits.

* :func:`permuted` deals the values of one column anew among the rows: the row at
  place i of one order gets the value of the row at place i of another, seeded one.
  Two distributed position tables and one join on the position; nothing is collected.
* :func:`auc` is the Mann-Whitney statistic over whole counts, ties as one half: counts per
  score, then running sums over score ranges.
* :func:`stratified_flag` gives each label exactly its share of training rows: the threshold on a row's hash
  is refined digit by digit from per-label histograms, with no sort of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.operators.ranks import dense_positions, running_sums
from blotter.session import stored

#: Bits of a row's hash that are refined at a time, and how often.
DIGIT_BITS, DIGITS = 12, 5


# --- permutation importance -----------------------------------------------------
def _order(salt: str, key: Column, rest: Sequence[str]) -> list[Column]:
    """By a salted hash of the key; rows that have one key are ordered by the other columns, so the order is fixed but for equal rows."""
    return [F.md5(F.concat(F.lit(salt + ":"), key)), *(F.col(c).asc_nulls_first() for c in rest)]


def permuted(df: DataFrame, column: str, key: Column, seed: int = 0) -> DataFrame:
    """``df`` with the values of ``column`` permuted among its rows; ``key``: text that names a row (never NULL)."""
    rest = sorted(df.columns)
    to = dense_positions(df, _order("to", key, rest), "__place")
    source = dense_positions(df, _order(f"from{seed}", key, rest), "__place").select("__place", F.col(column).alias("__value"))
    return to.join(source, "__place").withColumn(column, F.col("__value")).select(*df.columns)


def permutation_importance(df: DataFrame, predict: Callable[[DataFrame], DataFrame], columns: Sequence[str], key: Column,
                           seed: int = 0) -> DataFrame:
    """(feature, scored, correct, permuted_correct, importance): the accuracy lost when the feature's values are permuted.

    ``predict`` adds label and prediction to the rows that it scores.
    """
    def hits(rows: DataFrame, name: str) -> DataFrame:
        hit = (F.col("prediction") == F.col("label")).cast("long")
        return predict(rows).agg(F.count(F.lit(1)).alias(f"{name}scored"), F.coalesce(F.sum(hit), F.lit(0)).alias(f"{name}correct"))

    base = hits(df, "").first()
    out = None
    for c in columns:
        one = hits(permuted(df, c, key, seed), "permuted_").select(
            F.lit(c).alias("feature"), F.lit(base.scored).cast("long").alias("scored"), F.lit(base.correct).cast("long").alias("correct"), "permuted_correct",
            (F.lit(base.correct / max(base.scored, 1)) - F.try_divide("permuted_correct", "permuted_scored")).alias("importance"))
        out = one if out is None else out.unionByName(one)
    return out


# --- ranking and calibration ------------------------------------------------------
def auc(scored: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """One row: positives, negatives, twice_u (positive-negative pairs in order, ties 1, others 2 or 0) and auc.

    ``positive``: boolean.  Rows without score or class are left out.
    """
    known = scored.filter(F.col(score).isNotNull() & F.col(positive).isNotNull())
    counts = known.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    run = running_sums(counts, [F.col("score")], ["neg"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    got = run.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
                  F.coalesce(F.sum((wide("pos") * (2 * F.col("before_neg") + F.col("neg"))).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("twice_u"))
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return got.select("positives", "negatives", "twice_u", F.when(pairs > 0, F.col("twice_u").cast("double") / (2 * pairs)).alias("auc"))


def calibration(scored: DataFrame, bins: int = 10, score: str = "score", positive: str = "positive") -> DataFrame:
    """(bin, rows, positives, mean_score, positive_share): equal-width bins of scores from 0 to 1; 1 belongs to the last."""
    known = scored.filter(F.col(score).isNotNull() & F.col(positive).isNotNull())
    number = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(score) * bins))).cast("int")
    return known.groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(positive)).alias("positives"), F.avg(score).alias("mean_score"),
        F.avg(F.col(positive).cast("int")).alias("positive_share"))


# --- stratified split ---------------------------------------------------------------
def key_hash(key: Column) -> Column:
    """60 bits of the MD5 of a text key, as a long."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def stratified_flag(df: DataFrame, label: str, key: Column, train_percent: int = 80) -> DataFrame:
    """``df`` with ``in_train``: of the n rows of each label, the ``floor(n * percent / 100)`` with the smallest hashes.

    Rows that have one hash stay together, as training rows only if all of them fit in.  A NULL label is a label; a NULL key
    hashes as an empty text.  Five histogram passes over (label, hash); a pass counts the rows of one bucket per label.
    """
    if not 0 < train_percent < 100:
        return df.withColumn("in_train", F.lit(train_percent >= 100))
    text = F.coalesce(key, F.lit(""))
    hashed = stored(df.withColumn("__hash", key_hash(text)), "stratified")
    lab = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))
    keys = hashed.select(lab.alias("l"), F.col("__hash").alias("h"))
    # (l, prefix, left): rows below the prefix are in; ``left`` more are to be taken from the rows that have it
    state = keys.groupBy("l").agg(F.expr(f"count(1) * {train_percent} div 100").alias("left")).withColumn("prefix", F.lit(0).cast("long"))
    state = stored(state, "strata")
    for digit in range(1, DIGITS + 1):
        shift = DIGIT_BITS * (DIGITS - digit)
        open_ = keys.join(state, "l").filter(F.shiftright("h", shift + DIGIT_BITS) == F.col("prefix"))
        counts = open_.groupBy("l", "left", F.shiftright("h", shift).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        # at most 4096 buckets a label: the first whose running count exceeds what is left
        buckets = F.array_sort(F.collect_list(F.struct("p", "n")))
        found = counts.groupBy("l", "left").agg(buckets.alias("b")).select("l", "left", F.aggregate(
            "b", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("p")),
            lambda s, b: F.when(s["p"].isNotNull(), s)
            .when(s["sum"] + b["n"] > F.col("left"), F.struct(s["sum"].alias("sum"), b["p"].alias("p")))
            .otherwise(F.struct((s["sum"] + b["n"]).alias("sum"), F.lit(None).cast("long").alias("p")))).alias("s"))
        state = stored(found.select("l", (F.col("left") - F.col("s.sum")).alias("left"), F.col("s.p").alias("prefix")), "strata")
    flagged = hashed.withColumn("__l", lab).join(state.select(F.col("l").alias("__l"), F.col("prefix").alias("__at")), "__l")
    return flagged.withColumn("in_train", F.col("__hash") < F.col("__at")).drop("__l", "__at", "__hash")
