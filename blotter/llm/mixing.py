"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source gets a target number of words; a document of it should then be
taken ``rate = target / words of the source`` times.  The whole part of the
rate is certain.  The fractional part is a probability, and pivotal rounding
makes it 0 or 1: two documents of a source at a time exchange probability, in
proportion to their sizes, so that the expected words of the pair stay as they
are, until one of the two is decided; which way the mass goes is a coin whose
odds keep either document's probability right.  The undecided one meets the next.

The rounding is a reduction tree: documents are dealt by hash into chunks of
about :data:`CHUNK` rows of their source, each chunk is folded by itself and
leaves one undecided document, and the undecided ones of :data:`CHUNK` chunks
are folded at the next level.  At the root the last undecided document goes to
its nearer side, so a source's words miss their target by half a document at
most, and a source that holds a third of all rows is as many
small chunks as its size asks for.  Coins are hashes of the documents' keys
and the seed: reruns agree.

Defined cases: a null text has size 0; documents of size 0 are never taken;
null is a source like any other, and the last in order; repeated rows are
documents of their own; an empty table gives an empty result; null ids are
allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import boxed, text_of, unit, written

#: Runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3.0
CHUNK = 200
#: Repeated rows that one task numbers.
RUN = 1000


def sizes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(doc_id, source, text_key, size): all that the rounding needs of a document."""
    text = text_of(docs, text_column)
    return docs.select(docs[id_column].alias("doc_id"), docs[source_column].alias("source"),
                       F.xxhash64(text).alias("text_key"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: source_size, rows, target.

    Sources in code point order, null last, weigh ``weights`` in turn.  No
    target exceeds ``most`` times its source's size; the excess goes to the
    others by weight.  So target = min(most * size, level * weight) with one
    level for all: with the sources in order of size over weight, the level is
    what the first source that isn't capped sees.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    cap = F.lit(float(most)) * F.col("source_size")
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("seen", (F.sum("source_size").over(whole) - before) / rest)
    per = per.withColumn("level", F.first(F.when(F.col("seen") * F.col("weight") <= cap, F.col("seen")), ignorenulls=True).over(whole))
    target = F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "rows", target.alias("target"))


def _pair(state: Column, b: Column, seed: int) -> Column:
    """Fold step: the undecided document ``state.open`` meets ``b``; one of them is decided."""
    a, done = state["open"], state["done"]
    up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])        # words that a can gain from b
    down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])      # words that b can gain from a
    rise = unit(F.lit(seed), a["key"], b["key"], a["p"], b["p"]) * (up + down) < down
    a_first_up = (1 - a["p"]) * a["size"] <= b["p"] * b["size"]
    a_first_down = a["p"] * a["size"] <= (1 - b["p"]) * b["size"]
    a_done = F.when(rise, a_first_up).otherwise(a_first_down)
    p_a = F.when(rise, a["p"] + up / a["size"]).otherwise(a["p"] - down / a["size"])
    p_b = F.when(rise, b["p"] - up / b["size"]).otherwise(b["p"] + down / b["size"])
    # The decided one's last move brings it to exactly 1 or 0.
    decided = F.when(a_done, a.withField("p", F.when(rise, F.lit(1.0)).otherwise(F.lit(0.0)))) \
               .otherwise(b.withField("p", F.when(rise, F.lit(0.0)).otherwise(F.lit(1.0))))
    still = F.when(a_done, b.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p_b)))) \
             .otherwise(a.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p_a))))
    pair = F.struct(still.alias("open"), F.concat(done, F.array(decided)).alias("done"))
    return F.when(a.isNull(), F.struct(b.alias("open"), done.alias("done"))).otherwise(pair)


ITEM = "struct<key:bigint,doc_id:bigint,text_key:bigint,size:bigint,p:double,whole:bigint,source_size:bigint,target:double>"


def _fold(level: DataFrame, seed: int, id_type: str) -> DataFrame:
    """One level of the tree: (source, chunk, open, done) of the items of each chunk."""
    item = ITEM.replace("doc_id:bigint", f"doc_id:{id_type}")
    start = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast(f"array<{item}>").alias("done"))
    items = level.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return items.select("source", "chunk", F.aggregate("items", start, lambda s, x: _pair(s, x, seed)).alias("s")) \
                .select("source", "chunk", "s.open", "s.done")


def numbered(sized: DataFrame) -> DataFrame:
    """``sized`` with nth, the number of a row among its repetitions; many repetitions are counted, and dealt again in runs."""
    same = sized.groupBy("doc_id", "source", "text_key", "size").agg(F.count(F.lit(1)).alias("times"))
    runs = same.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {RUN}"))))
    many = runs.filter(F.col("times") > RUN).repartition("doc_id", "text_key", "run")
    rows = runs.filter(F.col("times") <= RUN).unionByName(many)
    first = F.col("run") * RUN
    return rows.withColumn("nth", F.explode(F.sequence(first, F.least(first + RUN, "times") - 1))).drop("times", "run")


def rounded(sized: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """Per document (doc_id, source, text_key, size, source_size, target, copies)."""
    id_type = dict(sized.dtypes)["doc_id"]
    sources = written(source_targets(sized, weights, most), "mix-sources")
    largest = sources.agg(F.max("rows")).first()[0] or 0
    rows = numbered(sized)
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    key = F.xxhash64(F.lit(seed), "doc_id", "text_key", "size", "nth")
    item = F.struct(key.alias("key"), "doc_id", "text_key", "size", "p", "whole", "source_size", "target")
    rows = rows.select("source", F.pmod(F.xxhash64(key), F.ceil(F.col("rows") / chunk)).alias("chunk"), item.alias("item"))
    sure = (F.col("item.p") <= 0) | (F.col("item.size") <= 0)
    done = [rows.filter(sure).select("source", F.col("item").withField("p", F.lit(0.0)).alias("item"))]
    level, chunks = rows.filter(~sure), max(1, math.ceil(largest / chunk))
    while True:
        folded = written(_fold(level, seed, id_type), "mix-level")
        done.append(folded.select("source", F.explode("done").alias("item")))
        level = folded.filter("open is not null").select("source", F.floor(F.col("chunk") / chunk).alias("chunk"),
                                                         F.col("open").alias("item"))
        if chunks == 1:
            break
        chunks = math.ceil(chunks / chunk)
    # The root's one undecided document of each source goes to the nearer side, half its size off at most.
    last = F.when(F.col("item.p") >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    done.append(level.select("source", F.col("item").withField("p", last).alias("item")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("item.doc_id", "source", "item.text_key", "item.size", "item.source_size", "item.target",
                      (F.col("item.whole") + F.col("item.p").cast("long")).alias("copies"))


def mix_table(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """How many words of each document the mix takes."""
    sized = written(sizes(docs), "mix-sizes")
    return rounded(sized, weights, most, seed).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Rows that are repeated in ``docs`` share out what they are given together.
    """
    sized = written(sizes(docs), "mix-sizes")
    took = rounded(sized, weights, most, seed).groupBy("doc_id", "text_key", "source").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    rows = boxed(docs, of=F.xxhash64(text_of(docs)))
    same = rows["row.doc_id"].eqNullSafe(took["doc_id"]) & (rows["of"] == took["text_key"]) & rows["row.source"].eqNullSafe(took["source"])
    rows = rows.join(took.filter("copies > 0"), same)
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_key", "source").orderBy("text_key"))
    rows = rows.withColumn("nth", F.when(F.col("rows") > 1, nth).otherwise(F.lit(1)))
    own = F.expr("copies div rows") + F.when(F.col("nth") <= F.expr("copies % rows"), 1).otherwise(0)
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), own.cast("int")))).select("row.*")
