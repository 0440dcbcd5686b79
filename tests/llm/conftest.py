import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Columns with names that the operators use inside.
CLASHING = ["size", "key", "fp", "tokens", "row", "score", "rank", "shard", "copies", "pack", "round", "_id", "_key"]


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, clashing=False):
        """rows: (doc_id, text, source)."""
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCUMENTS)
        return df.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else df
    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, an empty text, a very long one, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    same = "The same words stand in this text and in that one, for more than fifty bytes, under the MIT License."
    return [(0, None, "a"), (1, "", None), (2, long, "a"), (3, same, "b"), (4, same, "a"), (4, same, "a"), (None, same, "b"),
            (5, "  \t\n ", "c"), (6, "one", "c"), (7, "É ß 中 😀 don't <|endoftext|> 12½", None), (8, "x" * 400, "b")]
