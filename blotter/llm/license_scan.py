"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of every document is hashed and joined to the
positions of the same k-gram in the license templates.  A hit at document
word ``p`` and template word ``t`` votes for the diagonal ``p - t``: the place
where the whole template would begin.  Votes are summed by diagonal;
diagonals that lie within a template's slack of one another (words inserted
or left out) are merged; a merged span counts if the template k-grams that it
covers reach the template's share and its length fits the template.  Each hit
has been verified word by word, so no span rests on a hash alone.

Short phrases (up to :data:`SHORT` words) use 2-grams, no slack and full
coverage: their spans are exactly the places where their words stand
consecutively.  Longer templates use 4-grams, a tenth of their length as
slack and 60 % coverage.

Defined cases: a null text is an empty text (no words, no labels, score 0);
texts of fewer than two words have no k-gram; repeated rows give one result
row each; an empty table gives an empty result; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.common import text_of, written

# Fixed values of the contract: phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Opening words of public license notices, and their labels.
NOTICES = (
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)

#: Words of a text whose A-Z have been lowered: runs of digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The letters that are lowered; all others stay as they are.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHORT, SHORT_K, LONG_K = 4, 2, 4
LONG_SHARE = 0.6


@dataclass(frozen=True)
class Template:
    tid: int
    label: str
    words: tuple[str, ...]
    base: bool

    @property
    def k(self) -> int:
        return SHORT_K if len(self.words) <= SHORT else LONG_K

    @property
    def slack(self) -> int:
        return 0 if self.k == SHORT_K else len(self.words) // 10

    @property
    def share(self) -> float:
        return 1.0 if self.k == SHORT_K else LONG_SHARE


def templates(base=BASE, notices=NOTICES) -> list[Template]:
    found = [Template(i, label, tuple(text.split()), i < len(base)) for i, (text, label) in enumerate((*base, *notices))]
    if any(len(t.words) < t.k for t in found):
        raise ValueError(f"a template needs at least {SHORT_K} words")
    return found


def gram_table(spark: SparkSession, k: int, of: list[Template]) -> DataFrame:
    """(tid, t_pos, t_gram) of the templates with k-grams of this length: fixed by the templates, so bounded."""
    rows = [(t.tid, p, " ".join(t.words[p:p + k])) for t in of if t.k == k for p in range(len(t.words) - k + 1)]
    schema = "tid int, t_pos int, t_gram string"
    return spark.createDataFrame(rows, schema).withColumn("t_hash", F.xxhash64("t_gram"))


def _gram(k: int) -> Column:
    return F.concat_ws(" ", *(F.get("words", F.col("pos") + i) for i in range(k)))


def _hits(words: DataFrame, grams: DataFrame, k: int, name: str) -> DataFrame:
    """Left join of every rolling k-gram to the template positions; ``name`` holds the position found."""
    g = F.broadcast(grams.select(F.struct("tid", "t_pos").alias(name), F.col("t_gram").alias(f"{name}_gram"),
                                 F.col("t_hash").alias(f"{name}_hash")))
    here = (F.col("pos") >= 0) & (F.col("pos") <= F.col("n_words") - k)
    gram = F.when(here, _gram(k))
    return words.join(g, (F.xxhash64(gram) == g[f"{name}_hash"]) & (gram == g[f"{name}_gram"]), "left") \
                .drop(f"{name}_gram", f"{name}_hash")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
         of: list[Template] | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per document with its word count, its verified spans).

    Documents: id, text_key (hash of the text), n_words, copies (rows with this id and text).
    Spans: id, text_key, tid, first (word), length (words), coverage, verified.
    """
    spark, of = docs.sparkSession, of or templates()
    text = text_of(docs, text_column)
    words = docs.select(docs[id_column].alias("doc_id"), F.xxhash64(text).alias("text_key"),
                        F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(WORD), F.lit(0)).alias("words"))
    words = words.withColumn("n_words", F.size("words"))
    # One row per word position, and position -1 as the document's own row.
    at = words.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - SHORT_K, F.lit(-1)))).alias("pos"))
    for k, name in ((SHORT_K, "short"), (LONG_K, "long")):
        at = _hits(at, gram_table(spark, k, of), k, name)
    at = at.filter((F.col("pos") == -1) | F.col("short").isNotNull() | F.col("long").isNotNull())
    at = at.select("doc_id", "text_key", "n_words", "pos", F.explode(F.array("short", "long")).alias("hit"))
    votes = (at.filter(F.col("hit").isNotNull() | (F.col("pos") == -1))
               .groupBy("doc_id", "text_key", "n_words", F.col("hit.tid").alias("tid"),
                        (F.col("pos") - F.col("hit.t_pos")).alias("diagonal"))
               # the document's own row is seen once for either k-gram length
               .agg(F.collect_set("hit.t_pos").alias("seen"), F.expr("count(*) div 2").alias("copies")))
    votes = written(votes, "license-votes")  # read twice: the texts are scanned once
    documents = votes.filter("tid is null").select("doc_id", "text_key", "n_words", "copies")
    return documents, spans(spark, votes.filter("tid is not null"), of)


def spans(spark: SparkSession, votes: DataFrame, of: list[Template]) -> DataFrame:
    """Merge neighbouring diagonals of a document and template, and verify what they cover."""
    facts = spark.createDataFrame([(t.tid, len(t.words), t.k, t.slack, t.share) for t in of],
                                  "tid int, t_words int, k int, slack int, share double")
    v = votes.join(F.broadcast(facts), "tid")
    order = Window.partitionBy("doc_id", "text_key", "tid").orderBy("diagonal")
    v = v.withColumn("apart", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(1 << 30))
                               > F.col("slack")).cast("int"))
    v = v.withColumn("cluster", F.sum("apart").over(order))
    merged = v.groupBy("doc_id", "text_key", "n_words", "tid", "cluster", "t_words", "k", "slack", "share").agg(
        F.min(F.col("diagonal") + F.array_min("seen")).alias("first"),
        (F.max(F.col("diagonal") + F.array_max("seen") + F.col("k"))
         - F.min(F.col("diagonal") + F.array_min("seen"))).alias("length"),
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("covered"))
    coverage = F.col("covered") / (F.col("t_words") - F.col("k") + 1)
    fits = F.col("length") <= F.col("t_words") + 2 * F.col("slack")
    return merged.select("doc_id", "text_key", "n_words", "tid", F.col("first").cast("long").alias("first"),
                         F.col("length").cast("long").alias("length"), coverage.alias("coverage"),
                         ((coverage >= F.col("share")) & fits).alias("verified"))


def license_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   of: list[Template] | None = None) -> DataFrame:
    """One row per document: word count, base phrases, labels and the best coverage as score."""
    of = of or templates()
    documents, found = scan(docs, id_column, text_column, of)
    spark = docs.sparkSession
    names = F.broadcast(spark.createDataFrame([(t.tid, t.label, t.base) for t in of], "tid int, label string, base boolean"))
    base = F.col("verified") & F.col("base")
    rows = found.join(names, "tid").select("doc_id", "text_key", "n_words", F.lit(None).cast("long").alias("copies"),
                                           "label", "base", "verified", "first", "coverage")
    rows = rows.unionByName(documents, allowMissingColumns=True)
    labels = lambda when: F.concat_ws(",", F.sort_array(F.collect_set(F.when(when, F.col("label")))))
    out = rows.groupBy("doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("verified")).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"), F.max("copies").alias("copies"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))) \
              .drop("text_key", "copies", "copy")
