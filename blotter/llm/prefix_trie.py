"""The trie of conversation prefixes, its subtree totals by centroid decomposition.

Conversations are sequences of turns; each different sequence of first turns is a
node.  A node is named by its smallest member and its depth.  Steps:

* turns are numbered by a range sort with offsets for each partition, so one
  conversation of very many turns is no single task (:func:`numbered`);
* a prefix's key is the lane-wise sum of 128 bits of SHA-256 of (position, turn),
  summed in blocks of ``BLOCK`` positions; nodes are then checked to have
  one parent key and one last turn each, which by induction over the depth proves that equal
  keys are equal prefixes but for SHA-256 itself;
* subtree totals (:func:`subtree_totals`) come from the parent-edge forest.  A
  component's centroid is its deepest node whose subtree holds over half of the component.  Its
  component total is added to all nodes on the path from it to the component's top, it
  leaves, and the pieces are components of at most half the size.  Components over
  ``LOCAL`` nodes are split by Spark joins, all at once in each round, so there are at
  most log2(nodes / LOCAL) rounds; smaller ones are finished one at a time inside tasks.

Keys that hold a large share of the rows (a common first turn, one long
conversation) are joined by broadcast of their few rows (``common.lookup``).

Defined cases: rows with a null conv_id belong to no conversation and are left out; null
turns come first, equal turns are ordered by role and text; null role and text are empty; repeated rows are
turns of their own; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blotter.llm.common import lookup, written

#: Words of a turn.
WORD = r"[^\x20\x09-\x0D]+"
#: Positions whose keys are summed in one group.
BLOCK = 1024
#: Nodes of a component that one task finishes.
LOCAL = 20_000
#: Ids of one chunk of a node's list of ended conversations.
CHUNK = 50_000
_LANES = 4


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) without the rows of no conversation."""
    c = conversations
    empty = F.lit("")
    return c.filter(c["conv_id"].isNotNull()).select(
        c["conv_id"].cast("long").alias("conv"), c["turn"].alias("turn"), F.coalesce(c["role"].cast("string"), empty).alias("role"),
        F.coalesce(c["text"].cast("string"), empty).alias("text"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, rank from 1, turn_hash, words): a global range sort, ranks within a partition, and offsets between partitions."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = turns.repartitionByRange(parts, F.col("conv"), *order).select("*", F.spark_partition_id().alias("part"))
    local = Window.partitionBy("part", "conv").orderBy(*order)
    rows = written(placed.select("conv", "part", F.row_number().over(local).alias("near"),
                                 F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("turn_hash"),
                                 F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "trie-turns")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")) \
        .select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return lookup(rows, offset, ["conv", "part"]).select("conv", (F.col("near") + F.col("earlier")).alias("rank"), "turn_hash", "words")


def shared_heads(turns: DataFrame, group: int = 20, shares: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first of their group, h = crc32(conv) % shares.

    ``turns``: conv, rank, turn_hash, words.  Returns (conv, pos, turn_hash, words) and (conv, n).
    """
    convs = written(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")), "trie-convs")
    asks = convs.select("conv", "own", (F.col("conv") - F.col("conv") % group).alias("base"),
                        (F.crc32(F.col("conv").cast("string").cast("binary")) % shares).alias("h"))
    asks = asks.join(convs.select(F.col("conv").alias("base"), F.col("own").alias("base_turns")), "base", "left") \
        .withColumn("head", F.least("h", F.coalesce("base_turns", F.lit(0))))
    asks = written(asks.select("conv", "own", "base", "h", "head"), "trie-asks")
    heads = turns.filter(F.col("rank") < shares).select(F.col("conv").alias("base"), F.col("rank").alias("pos"), "turn_hash", "words") \
        .join(asks.select("conv", "base", "head"), "base").filter("pos <= head").select("conv", "pos", "turn_hash", "words")
    tails = lookup(turns, asks.select("conv", "h", "head"), ["conv"]).filter("rank > h") \
        .select("conv", (F.col("head") + F.col("rank") - F.col("h")).alias("pos"), "turn_hash", "words")
    lengths = asks.select("conv", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return heads.unionByName(tails), lengths


def _lanes(hex_: Column) -> list[Column]:
    return [F.conv(F.substring(hex_, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(_LANES)]


def prefixes(sequences: DataFrame) -> DataFrame:
    """(conv, pos, key, above, turn_hash, words): ``key`` names the first ``pos`` turns, ``above`` all but the last of them."""
    names = [f"l{i}" for i in range(_LANES)]
    mixed = sequences.withColumn("m", F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "turn_hash"), 256))
    rows = written(mixed.select("conv", "pos", "turn_hash", "words", F.floor(F.col("pos") / BLOCK).alias("block"),
                                *(c.alias(n) for c, n in zip(_lanes(F.col("m")), names))), "trie-lanes")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(*(F.sum(n).alias(n) for n in names)) \
        .select("conv", "block", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias("b" + n) for n in names))
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select("*", *(F.sum(n).over(inside).alias("r" + n) for n in names)).join(blocks, ["conv", "block"])
    now = F.concat_ws("-", *(F.col("r" + n) + F.col("b" + n) for n in names))
    past = F.concat_ws("-", *(F.col("r" + n) + F.col("b" + n) - F.col(n) for n in names))
    return run.select("conv", "pos", now.alias("key"), past.alias("above"), "turn_hash", "words")


# --- subtree totals -------------------------------------------------------------
def centroid_totals(parent: list[int], values: list[list[int]]) -> None:
    """Turns each list of node values into subtree totals; ``parent[i] < i`` (a negative one: top).

    Components are split at their centroids until none is left; a centroid's
    total goes to the nodes on the path from it to its component's top.
    """
    own = [v[:] for v in values]
    size = [1] * len(parent)
    todo = []
    if parent:
        component = [0] * len(parent)
        tops: dict[int, list[int]] = {}
        for i, p in enumerate(parent):
            component[i] = i if p < 0 else component[p]
            tops.setdefault(component[i], []).append(i)
        todo = list(tops.values())
    gone = [False] * len(parent)
    while todo:
        nodes = todo.pop()
        members = set(nodes)
        for i in nodes:
            size[i] = 1
        for i in reversed(nodes):
            if parent[i] in members:
                size[parent[i]] += size[i]
        half = len(nodes) // 2
        centre = max(i for i in nodes if size[i] > half)
        below, pieces, upper = {centre: -1}, {}, []
        totals = [v[centre] for v in own]
        for i in nodes:
            if i == centre:
                continue
            p = parent[i]
            if p in below and i > centre:
                below[i] = i if p == centre else below[p]
                pieces.setdefault(below[i], []).append(i)
                for k, v in enumerate(own):
                    totals[k] += v[i]
            else:
                upper.append(i)
        at = parent[centre]
        for k, v in enumerate(values):
            v[centre] += totals[k] - own[k][centre]
        while at in members and not gone[at]:
            for k, v in enumerate(values):
                v[at] += totals[k]
            at = parent[at]
        gone[centre] = True
        todo += [x for x in (*pieces.values(), upper) if x]


def _finished(state: DataFrame, names: list[str]) -> DataFrame:
    """(conv, depth, names): the totals of components that are whole in one task, one component after another."""
    def close(rows: list[tuple]) -> list[tuple]:
        at = {row[2:4]: i for i, row in enumerate(rows)}
        parent = [at.get((row[4], row[3] - 1), -1) for row in rows]
        values = [[row[5 + k] for row in rows] for k in range(len(names))]
        centroid_totals(parent, values)
        return [(*row[2:4], *(v[i] + row[5 + len(names) + k] for k, v in enumerate(values))) for i, row in enumerate(rows)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["conv", "depth", *names])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if held and held[-1][:2] != row[:2]:
                    out += close(held)
                    held = []
                held.append(row)
            if len(out) > 10_000:
                yield batch(out)
                out = []
        out += close(held) if held else []
        if out:
            yield batch(out)

    columns = ["top_conv", "top_depth", "conv", "depth", "parent_conv", *names, *("acc_" + n for n in names)]
    dealt = state.select(*columns).repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth", "depth", "conv")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in ("conv", "depth", *names)))


def subtree_totals(nodes: DataFrame, paths: DataFrame, names: list[str], local: int = LOCAL) -> DataFrame:
    """(conv, depth, names): the sums of ``names`` over the subtrees of a tree, by centroid decomposition.

    ``nodes``: conv, depth, parent_conv (the parent is at depth - 1; null: the root),
    size (nodes of the subtree), names (long).  ``paths``: (conv, depth, node_conv,
    next_conv) gives for every conv the nodes from the top to its last one.
    """
    root = nodes.filter("parent_conv is null").select("conv", "depth").first()
    if root is None:
        return nodes.select("conv", "depth", *names)
    state = written(nodes.select("*", F.lit(root.conv).alias("top_conv"), F.lit(root.depth).cast("long").alias("top_depth"),
                                 *(F.lit(0).cast("long").alias("acc_" + n) for n in names)), "trie-state")
    comp, node = ["top_conv", "top_depth"], ["conv", "depth"]
    done: list[DataFrame] = []
    while True:
        sizes = written(state.groupBy(*comp).agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
        big = sizes.filter(F.col("n") > local)
        if big.isEmpty():
            done.append(_finished(state, names))
            break
        sized = written(lookup(state, sizes, comp), "trie-sized")
        done.append(_finished(sized.filter(F.col("n") <= local), names))
        large = sized.filter(F.col("n") > local)
        centre = large.filter(F.col("size") * 2 > F.col("n")).groupBy(*comp) \
            .agg(F.max_by(F.struct("conv", "depth"), "depth").alias("c")) \
            .select(*comp, F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"))
        large = written(lookup(large, centre, comp), "trie-large")
        # The node of each row's path at its centroid's depth, and the next one.
        at = paths.select(F.col("conv"), F.col("depth").alias("c_depth"), F.col("node_conv").alias("at_conv"), "next_conv")
        flagged = lookup(large, at, ["conv", "c_depth"]) \
            .withColumn("below", (F.col("depth") >= F.col("c_depth")) & F.coalesce(F.col("at_conv") == F.col("c_conv"), F.lit(False)))
        flagged = written(flagged, "trie-below")
        totals = written(flagged.filter("below").groupBy(*comp, "c_conv", "c_depth")
                         .agg(F.count(F.lit(1)).alias("cut"), *(F.sum(n).alias("sum_" + n) for n in names)), "trie-totals")
        path = totals.join(paths.select(F.col("conv").alias("c_conv"), F.col("depth").alias("p_depth"), "node_conv"), "c_conv") \
            .filter((F.col("p_depth") >= F.col("top_depth")) & (F.col("p_depth") < F.col("c_depth"))) \
            .select(F.col("node_conv").alias("conv"), F.col("p_depth").alias("depth"), "cut", *("sum_" + n for n in names))
        is_centre = (F.col("conv") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        own = flagged.filter(is_centre).join(totals.select(*comp, *("sum_" + n for n in names)), comp)
        done.append(own.select(*node, *((F.col("sum_" + n) + F.col("acc_" + n)).alias(n) for n in names)))
        rest = flagged.filter(~is_centre).join(path, node, "left")
        state = written(rest.select(
            *node, "parent_conv", (F.col("size") - F.coalesce("cut", F.lit(0))).alias("size"), *names,
            F.when(F.col("below"), F.col("next_conv")).otherwise(F.col("top_conv")).alias("top_conv"),
            F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            *((F.col("acc_" + n) + F.coalesce("sum_" + n, F.lit(0))).alias("acc_" + n) for n in names)), "trie-state")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(node_conv, depth, ends_sha256): SHA-256 of the comma-joined ids, in order; ids are joined to chunks where they are sorted."""
    def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node_conv", "depth", "first", "ids"]
        rows: list[tuple] = []
        node, held = None, []
        for part in parts:
            for *at, conv in zip(*(c.to_pylist() for c in part.columns)):
                if held and (at != node or len(held) >= CHUNK):
                    rows.append((*node, held[0], ",".join(map(str, held))))
                    held = []
                node = at
                held.append(conv)
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                rows = []
        if held:
            rows.append((*node, held[0], ",".join(map(str, held))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        node, state = None, None
        for part in parts:
            for *at, _, ids in zip(*(c.to_pylist() for c in part.columns)):
                if at != node:
                    if state is not None:
                        rows.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            rows.append((*node, state.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["node_conv", "depth", "ends_sha256"])

    spark = ends.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["node_conv", "depth", "conv"]
    joined = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order) \
        .mapInArrow(chunks, "node_conv long, depth long, first long, ids string")
    return joined.repartition("node_conv", "depth").sortWithinPartitions("node_conv", "depth", "first") \
        .mapInArrow(hashes, "node_conv long, depth long, ends_sha256 string")


def trie(sequences: DataFrame, lengths: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv, pos from 1, turn_hash, words); ``lengths`` (conv, n) has every conversation."""
    lengths = written(lengths, "trie-lengths")
    rows = written(prefixes(sequences), "trie-prefixes")
    found = rows.groupBy("pos", "key").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.min("words").alias("words"),
        (F.min("above") == F.max("above")).alias("one_parent"), (F.min("turn_hash") == F.max("turn_hash")).alias("one_turn"))
    checked = F.assert_true(F.col("one_parent") & F.col("one_turn"), "two prefixes have one key")
    found = written(found.filter(checked.isNull()).select("pos", "key", "n_convs", "conv", "words"), "trie-found")
    everyone = lengths.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"))
    root = everyone.first()
    at = lookup(rows.select("conv", "pos", "key"), found.select("pos", "key", F.col("conv").alias("node_conv")), ["pos", "key"])
    first = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(root.conv).cast("long").alias("node_conv"))
    steps = written(at.select("conv", F.col("pos").cast("long").alias("depth"), "node_conv").unionByName(first), "trie-steps")
    following = steps.select("conv", (F.col("depth") - 1).alias("depth"), F.col("node_conv").alias("next_conv"))
    paths = written(steps.join(following, ["conv", "depth"], "left"), "trie-paths")

    nodes = found.select("conv", F.col("pos").cast("long").alias("depth"), "n_convs", "words") \
        .unionByName(everyone.filter("n_convs > 0").select("conv", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words")))
    parents = steps.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node_conv").alias("parent_conv"))
    nodes = written(nodes.join(parents, ["conv", "depth"], "left"), "trie-nodes")
    children = nodes.filter("parent_conv is not null").groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    # A conversation owns the end of its path from the first node of which it is the smallest member: sizes are sums over members.
    owned = nodes.groupBy("conv").agg(F.min("depth").alias("owns")).join(lengths, "conv")
    members = lookup(steps, owned, ["conv"]).filter("owns is not null") \
        .groupBy(F.col("node_conv").alias("conv"), "depth").agg(F.sum(F.col("n") - F.greatest("depth", "owns") + 1).alias("size"))
    full = nodes.join(children, ["conv", "depth"], "left").join(members, ["conv", "depth"]) \
        .select("conv", "depth", "parent_conv", "n_convs", "size", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("words")).cast("long").alias("saved_tokens"))
    full = written(full, "trie-full")
    totals = subtree_totals(full.select("conv", "depth", "parent_conv", "size", "n_leaves", "saved_tokens"), paths, ["n_leaves", "saved_tokens"], local)
    ends = _end_hashes(paths.filter("next_conv is null").select("node_conv", "depth", "conv"))
    none = hashlib.sha256(b"").hexdigest()
    return full.drop("n_leaves", "saved_tokens", "size").join(totals, ["conv", "depth"]) \
        .join(ends.withColumnRenamed("node_conv", "conv"), ["conv", "depth"], "left") \
        .select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 20, shares: int = 4, local: int = LOCAL) -> DataFrame:
    """The trie of all conversations, rebuilt with shared heads (:func:`shared_heads`)."""
    sequences, lengths = shared_heads(written(numbered(turns_of(conversations)), "trie-numbered"), group, shares)
    return trie(sequences, lengths, local)
