"""Raw incidents -> random-forest status classifier, scored and explained.

try_cast the numeric inputs -> deterministic 80/20 split by key -> the pruned
rows written to the shared folder -> fit indexers, one-hot, address hash,
label indexer, assembler, forest -> score the held-out rows once, written to
the shared folder -> accuracy, confusion matrix, importances summed per input
column.  The raw table is read once in all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blotter.operators import classify
from blotter.operators.index import ExactIndex
from blotter.session import stored


@dataclass
class Classification:
    model: PipelineModel
    scored: DataFrame          # the written predictions
    features: list[str]
    test: DataFrame            # the held-out rows, from the written table
    assembled: DataFrame       # the plan behind ``scored``: its schema holds the vector's layout

    def skipped(self) -> DataFrame:
        """One row: held-out rows, those lost to a NULL input (and per input), to an unseen value, and scored ones."""
        inputs = [*classify.NUMERIC_INT, *classify.CATEGORICAL, classify.LABEL_SOURCE]
        lost = classify.skipped_rows(self.test, [c for c in inputs if c in self.test.columns])
        scored = F.lit(self.scored.count())
        return lost.withColumns({"scored": scored, "unseen": F.col("rows") - F.col("skipped") - scored})

    def accuracy(self) -> DataFrame:
        return classify.accuracy(self.scored)

    def confusion(self) -> DataFrame:
        return classify.confusion(self.scored)

    def importances(self) -> list[tuple[str, float]]:
        return classify.importances_by_input(self.model, self.assembled, self.features)

    def predictions(self) -> DataFrame:
        out = classify.decode_prediction(self.scored, classify.label_names(self.model))
        return out.select("dr_no", "vict_age", "vict_sex", "vict_descent", "premis_desc", "weapon_desc",
                          "location", "status_desc", out["prediction"].cast("int").alias("prediction"),
                          "predicted")


def train_classifier(raw: DataFrame, key: Column, train_percent: int = 80, num_trees: int = 10,
                     seed: int = 42, location_encoding: str = "hashed",
                     hash_width: int = classify.HASH_WIDTH) -> Classification:
    """Fit and score the status classifier.

    ``location_encoding``:

    * ``"hashed"`` (default) -- the address as one of ``hash_width`` slots
      (:func:`classify.hasher`).  Categorical like the reference's form, but width
      and driver state stay constant however many addresses exist.
    * ``"frequency"`` -- one numeric input, the address's incident count in the
      training rows (:func:`classify.frequency_encode`).
    * ``"onehot"`` -- the reference's form: indexed and one-hot encoded like
      the other categories.  Spark ML keeps the label list on the driver and
      bins every slot of every row; where that would take too much
      (:func:`classify.too_wide`), the addresses are indexed by
      :class:`~blotter.operators.index.ExactIndex` and the forest grows on the same slots without
      laying them out (:mod:`blotter.operators.forest`).

    The raw rows are read once: key, inputs and label go to a table in the
    shared folder, which every later pass reads, so a lost executor costs its
    own tasks only.  The scored rows are written there once, too.  An address
    that is NULL is skipped in every form, as the indexer skips the other categories.
    """
    if location_encoding not in ("hashed", "frequency", "onehot"):
        raise ValueError(f"unknown location_encoding {location_encoding!r}")
    inputs = [c for c in classify.NUMERIC_INT if c in classify.FEATURES]
    needed = dict.fromkeys(["dr_no", *classify.CATEGORICAL, classify.LABEL_SOURCE, *inputs])
    rows = classify.typed_features(raw).withColumn("in_train", classify.split_flag(key, train_percent))
    rows = stored(rows.select(*needed, "in_train"), "classifier-rows")
    held_out = rows.filter(~F.col("in_train")).drop("in_train")
    train = rows.filter("in_train and location is not null").drop("in_train")
    test = held_out.filter("location is not null")
    categorical, features, hashed = classify.CATEGORICAL, classify.FEATURES, []
    wide = location_encoding == "onehot" and classify.too_wide(train, "location")
    if location_encoding != "onehot" or wide:
        categorical = [c for c in categorical if c != "location"]
    if location_encoding == "hashed":
        hashed = ["location"]
    if location_encoding == "frequency":
        features = [f if f != "location_encoded" else "location_freq" for f in features]
        train, (test,) = classify.frequency_encode(train, [test], "location", "location_freq")
    if wide:
        plain, index = train, ExactIndex(train, ["location"])     # every training address has an index
        train, test = (index.transform(df, "location", "location_index") for df in (train, test))
    pipeline = classify.build_pipeline(categorical, [f for f in features if not wide or f != "location_encoded"],
                                       num_trees=num_trees, seed=seed, hashed=hashed, hash_width=hash_width)
    model = classify.fit_wide(pipeline, train, index, "location", features, plain) if wide else classify.fit(pipeline, train)
    assembled = model.transform(test)
    scored = stored(assembled.select(*needed, "label", "prediction"), "classifier-scored")
    return Classification(model, scored, features, held_out, assembled)
