"""From raw documents to packed training sequences: five stages, each over all that the one before has kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``.  ``run`` writes each stage's
result as Parquet to the cluster's shared folder and reads it again as the
next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm.common import scope, table, tidy
from blotter.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ordinal grades learnt from the rated documents; those that are probably of the lowest grade go."""
    from blotter.llm.quality import graded, ratings_of
    return graded(docs, ratings_of(table(spark, sf_dir, "labels"))).filter("keep").select("row.*")


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, the one with the smallest id."""
    from blotter.llm.simhash import one_of_each
    return one_of_each(docs)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand in a document with a smaller id are cut out; n_chars follows the text."""
    from blotter.llm.substrings import without_repeats
    out = without_repeats(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight gives it."""
    from blotter.llm.mixing import mix_documents
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    from blotter.llm.packing import pack
    return pack(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", simhash), ("suffix-array dedup", suffixes),
          ("mixing sources", mixing), ("packing", packing)]

#: Gradient descent, suffix arrays and tokenizers have no SQL form; tests hold each stage against brute force or its labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_dir(spark, f"stage-{i}")
        with scope(spark):  # what the stage wrote on its way goes, its result stays
            out = stage(spark, docs, sf_dir)
            with tidy(spark):
                out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
