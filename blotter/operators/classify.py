"""Deterministic split, the random-forest pipeline, metrics and importances.

Fitting is Spark ML (distributed): the StringIndexer runs one count job and
keeps its label lists on the driver, so an input with unbounded values (the
address) is hashed to a fixed width instead; the forest trains level by level
with split statistics aggregated on executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.functions import to_double, to_int
from blotter.operators.forest import SlotForestModel, Slots, fit_forest
from blotter.operators.index import ExactIndex


# --- split ------------------------------------------------------------------
# --- fixed values: the split's mixing step (Park-Miller minimal standard) ---
MIX_MODULUS = 2147483647    # 2**31 - 1, prime
MIX_MULTIPLIER = 48271


def split_bucket(key: str | Column, salt: int = 0) -> Column:
    """A bucket 0..99 from an integer key: two Park-Miller steps, then mod 100.

    Every product stays below 2**47, so no overflow under ANSI mode for any
    64-bit key (hash keys included); the steps scramble low digits, so keys
    built like ``order * 10 + line`` do not split by their last digits.
    """
    k = F.col(key) if isinstance(key, str) else key
    m, a = F.lit(MIX_MODULUS), F.lit(MIX_MULTIPLIER)
    h = F.pmod(F.pmod(k.cast("long"), m) + salt, m)
    h = F.pmod(h * a, m)
    h = F.pmod(h * a, m)
    return F.pmod(h, F.lit(100))


def split_flag(key: str | Column, train_percent: int = 80, salt: int = 0) -> Column:
    """True for training rows: ``split_bucket(key, salt) < train_percent``.

    Depends on the key only, never on partitioning or task order, so it is
    the same on every run and every cluster layout (``randomSplit`` is not).
    Never NULL: a row without a key is a test row, so the two parts hold every row.
    """
    return F.coalesce(split_bucket(key, salt) < train_percent, F.lit(False))


def row_key(text: str | Column) -> Column:
    """A whole-number key of any text: its own value if it is one, else 60 bits of its MD5 (NULL: NULL)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.try_cast("long"), F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long"))


def key_split(df: DataFrame, key: str | Column, train_percent: int = 80,
              salt: int = 0) -> tuple[DataFrame, DataFrame]:
    flag = split_flag(key, train_percent, salt)
    return df.filter(flag), df.filter(~flag)


# --- features -----------------------------------------------------------------
# --- fixed values: inputs of the reference's classification, in snake_case names ---
CATEGORICAL = ["vict_sex", "vict_descent", "premis_desc", "weapon_desc", "location"]
NUMERIC_INT = ["vict_age", "crm_cd", "premis_cd", "rpt_dist_no", "weapon_used_cd"]
NUMERIC_DOUBLE = ["lat", "lon"]
FEATURES = ["vict_age", "vict_sex_encoded", "vict_descent_encoded", "crm_cd", "premis_cd",
            "rpt_dist_no", "premis_desc_encoded", "weapon_used_cd", "location_encoded"]
LABEL_SOURCE = "status_desc"
HASH_WIDTH = 64     # slots of a hashed category


def typed_features(raw: DataFrame) -> DataFrame:
    """``try_cast`` the numeric inputs (bad text -> NULL) in one projection."""
    casts = {c: to_int(c) for c in NUMERIC_INT if c in raw.columns}
    casts.update({c: to_double(c) for c in NUMERIC_DOUBLE if c in raw.columns})
    return raw.withColumns(casts)


def hasher(column: str, out: str, width: int = HASH_WIDTH) -> FeatureHasher:
    """A category as one of ``width`` slots: no labels on the driver, the same width for any number of values.

    Values may share a slot; a NULL has no slot at all, so filter it out first.
    """
    return FeatureHasher(inputCols=[column], categoricalCols=[column], outputCol=out, numFeatures=width)


def frequency_encode(train: DataFrame, others: Sequence[DataFrame], column: str, out: str,
                     max_broadcast_rows: int = 1_000_000) -> tuple[DataFrame, list[DataFrame]]:
    """Encode a high-cardinality category by its row count in the training rows.

    One partial aggregation of the training rows (a hot value is one row per
    task before the shuffle), then a left join back onto every table; values
    unseen in training get 0.  The count table has one row per distinct value;
    it is broadcast only when that number, counted first, is within
    ``max_broadcast_rows``, otherwise joined by shuffle (AQE splits skew).
    NULL values keep a NULL code, so the assembler skips them as the
    reference's indexer would.
    """
    counts = train.filter(F.col(column).isNotNull()).groupBy(column) \
                  .agg(F.count(F.lit(1)).cast("double").alias(out))
    right = F.broadcast(counts) if counts.count() <= max_broadcast_rows else counts

    def enc(df: DataFrame) -> DataFrame:
        j = df.join(right, column, "left")
        return j.withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce(F.col(out), F.lit(0.0))))

    return enc(train), [enc(o) for o in others]


def build_pipeline(categorical: Sequence[str] = CATEGORICAL, features: Sequence[str] = FEATURES,
                   label_source: str = LABEL_SOURCE, num_trees: int = 10, seed: int = 42,
                   assembler_invalid: str = "skip", hashed: Sequence[str] = (),
                   hash_width: int = HASH_WIDTH, **rf_params) -> Pipeline:
    """Indexers (skip NULL/unseen) -> one-hot -> hashed inputs -> assembler -> random forest.

    The categorical inputs and the label are indexed by one multi-column
    StringIndexer (one counting pass, not one per column; a row with a NULL or
    unseen value in any of them is skipped, as separate indexers would).
    Labels are ordered by count descending, ties by value.  The forest keeps
    Spark's defaults (depth 5, 32 bins, gini) with a fixed seed.
    """
    cats = list(categorical)
    index = StringIndexer(inputCols=[*cats, label_source],
                          outputCols=[*[f"{c}_index" for c in cats], "label"], handleInvalid="skip")
    stages = [index]
    if cats:
        stages.append(OneHotEncoder(inputCols=[f"{c}_index" for c in cats],
                                    outputCols=[f"{c}_encoded" for c in cats]))
    stages += [hasher(c, f"{c}_encoded", hash_width) for c in hashed]
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid=assembler_invalid)
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=num_trees,
                                seed=seed, **rf_params)
    return Pipeline(stages=[*stages, asm, rf])


#: Bytes of binned rows that one training task keeps, about.
TASK_BYTES = 128 * 1024 * 1024


def training_tasks(rows: int, slots: int, task_bytes: int = TASK_BYTES) -> int:
    """Tasks over which training rows are dealt: the forest keeps four bytes for every slot of a row, and some 200 besides."""
    return max(1, math.ceil(rows * (4 * slots + 200) / task_bytes))


def fit(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Fit the feature stages, then the forest on persisted (features, label) rows.

    The forest reads its input several times (row count, split sampling,
    binning); persisting only the two columns it needs keeps the indexer,
    hasher and assembler from re-running each time.  The forest then keeps every row
    with all its slots in memory or on disk, one block per task, so many rows are first dealt
    over as many tasks as :func:`training_tasks` says.  A lost block is
    recomputed from its lineage, so the persist costs no fault tolerance.
    Returns one PipelineModel.
    """
    stages = pipeline.getStages()
    prep = Pipeline(stages=stages[:-1]).fit(train)
    learner = stages[-1]
    of = lambda rows: prep.transform(rows).select(learner.getFeaturesCol(), learner.getLabelCol())
    feats = of(train)
    tasks = training_tasks(train.count(), feats.schema[learner.getFeaturesCol()].metadata["ml_attr"]["num_attrs"])
    if tasks > train.sparkSession.sparkContext.defaultParallelism:
        feats = of(train.repartition(tasks))
    feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        forest = learner.fit(feats)
    finally:
        feats.unpersist()
    return PipelineModel(stages=[*prep.stages, forest])


#: Bytes of binned rows up to which the forest lays out every slot of every row.
LAID_OUT_BYTES = 2 * 1024 ** 3


def too_wide(train: DataFrame, column: str, limit: int | None = None) -> bool:
    """Whether the forest's rows with every value of ``column`` as a slot take more than ``limit`` bytes, about."""
    n = train.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(column).alias("values")).first()
    return n["rows"] * (4 * n["values"] + 200) > (LAID_OUT_BYTES if limit is None else limit)


def fit_wide(pipeline: Pipeline, train: DataFrame, index: ExactIndex, column: str,
             features: Sequence[str] = FEATURES, plain: DataFrame | None = None) -> PipelineModel:
    """:func:`fit` with one more one-hot input, ``column``, whose slots are never laid out.

    ``pipeline`` holds the other inputs; ``train`` (and every table the model scores) has the
    index of ``column`` as ``<column>_index``.  The vector's layout is that of ``features``: an index of a category is
    its slot, the last one has none, as the one-hot encoder gives them.
    Rows and inputs are the same as with the laid-out slots, the learner is :func:`fit_forest`.

    ``plain``: the rows of ``train`` before their indexes were joined, if the join kept all of them; the other
    stages are then fitted and the rows counted there, and the join runs only for the forest's own rows.
    """
    stages, plain = pipeline.getStages(), train if plain is None else plain
    prep, learner = Pipeline(stages=stages[:-1]).fit(plain), stages[-1]
    rows = prep.transform(train)
    inputs = []
    for f in features:
        source = f.removesuffix("_encoded")
        if source == f:
            inputs.append((f, f, None))
        else:
            width = max(0, index.sizes[column] - 1) if source == column else rows.schema[f].metadata["ml_attr"]["num_attrs"]
            inputs.append((f, f"{source}_index", width))
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, training_tasks(plain.count(), len(inputs)))
    forest = fit_forest(rows, Slots(inputs), len(label_names(PipelineModel(stages=prep.stages))), learner.getNumTrees(),
                        learner.getSeed(), learner.getMaxDepth(), learner.getBootstrap(), tasks)
    return PipelineModel(stages=[*prep.stages, forest])


def label_names(model: PipelineModel) -> list[str]:
    """Label texts in index order (the indexer's fitted labels for the ``label`` output)."""
    for stage in model.stages:
        if not hasattr(stage, "labelsArray"):
            continue
        outs = stage.getOutputCols() if stage.isSet("outputCols") else [stage.getOutputCol()]
        if "label" in outs:
            return list(stage.labelsArray[outs.index("label")])
    raise ValueError("no label indexer in the pipeline")


def decode_prediction(predictions: DataFrame, labels: list[str], name: str = "predicted") -> DataFrame:
    """Prediction index -> label text through a literal array (labels: a handful of statuses)."""
    arr = F.array(*[F.lit(x) for x in labels])
    return predictions.withColumn(name, F.element_at(arr, (F.col("prediction") + 1).cast("int")))


def skipped_rows(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Rows that indexer or assembler skip for a NULL input, counted in one pass.

    One row: ``rows``, ``skipped`` and ``null_<input>`` per input; both run
    with ``handleInvalid="skip"``, so these rows are reported here instead of
    failing the fit.
    """
    any_null = F.lit(False)
    for c in inputs:
        any_null = any_null | F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(any_null).alias("skipped"),
                  *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in inputs])


# --- baseline -------------------------------------------------------------------
def baseline(train: DataFrame, test: DataFrame, by: str, label_source: str = LABEL_SOURCE) -> DataFrame:
    """``test`` scored by the most frequent training label of its ``by`` value: what a model has to beat.

    Adds ``label`` and ``prediction`` (indices as the indexer gives them).
    Ties go to the more frequent label; a value unseen in training gets the
    most frequent label of all; rows with a NULL ``by`` or label, or a label unseen in
    training, are skipped.
    """
    train, test = train.filter(F.col(by).isNotNull()), test.filter(F.col(by).isNotNull())
    codes = StringIndexer(inputCol=label_source, outputCol="label", handleInvalid="skip").fit(train)
    counts = codes.transform(train).groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(by).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("prediction"))
    return codes.transform(test).join(best, by, "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


# --- metrics ------------------------------------------------------------------
def accuracy(predictions: DataFrame) -> DataFrame:
    """One row: scored rows, correct rows, accuracy (share of prediction == label)."""
    hit = (F.col("prediction") == F.col("label")).cast("long")
    return predictions.agg(F.count(F.lit(1)).alias("scored"), F.sum(hit).alias("correct"),
                           F.avg(hit.cast("double")).alias("accuracy"))


def confusion(predictions: DataFrame) -> DataFrame:
    """(``label``, ``prediction``, ``count``): the confusion matrix as rows."""
    return predictions.groupBy(F.col("label").cast("int").alias("label"),
                               F.col("prediction").cast("int").alias("prediction")) \
                      .agg(F.count(F.lit(1)).alias("count"))


def slot_owners(schema, inputs: Sequence[str]) -> list[str]:
    """The input column of every assembled vector slot, in slot order.

    The assembler lays its inputs side by side: a number takes one slot, a
    vector as many as its own metadata says.
    """
    owners: list[str] = []
    for name in inputs:
        field = schema[name]
        width = field.metadata["ml_attr"]["num_attrs"] if field.dataType.typeName() == "vectorudt" else 1
        owners += [name] * width
    return owners


def importances_by_input(model: PipelineModel, scored: DataFrame,
                         inputs: Sequence[str] = FEATURES) -> list[tuple[str, float]]:
    """Forest importances summed over the slots of each input column (sum is 1)."""
    forest = model.stages[-1]
    owners = forest.owners() if isinstance(forest, SlotForestModel) else slot_owners(scored.schema, inputs)
    return fold_slots(forest.featureImportances.toArray(), owners, inputs)


def fold_slots(values: Sequence[float], owners: Sequence[str], inputs: Sequence[str]) -> list[tuple[str, float]]:
    """Values of vector slots summed per owning input, in the order of the inputs."""
    if len(owners) != len(values):
        raise ValueError(f"{len(values)} vector slots, but the inputs take {len(owners)}")
    sums = {i: 0.0 for i in inputs}
    for owner, value in zip(owners, values):
        sums[owner] += float(value)
    return list(sums.items())
