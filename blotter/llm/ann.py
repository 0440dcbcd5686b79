"""Nearest neighbours by cosine with multiprobe p-stable hashing.

Vectors are brought to unit length, where the largest cosine is the smallest
distance.  Each of TABLES tables has FUNCTIONS Gaussian projections, cut into
cells of WIDTH; a vector's cells name its bucket.  A query visits, in every
table, its own bucket and the neighbouring ones (one cell up or down in any
function) in the order of their estimated success: the sum of the squared
distances to the cell walls that must be crossed.  The candidates of all
buckets and tables are ranked by their exact cosine in double precision.

Equal vectors are one entry that keeps as many of its smallest ids as a result
can hold, and queries with equal vectors are searched once, so a vector that a
third of the rows share costs no more than any other.  Index rows are dealt to
blocks by bucket; a bucket with more than BLOCK rows is cut by hash.  A query
goes to a block once, with the list of buckets it visits there, and leaves it
with its best candidates only.  Index rows are shuffled once, however many queries there are: a
block's rows are held, its queries stream past them, and only visited buckets are multiplied.

Defined cases: vectors that are null, empty or zero, or hold a null or a
component that isn't finite, and rows without an id, take no part; vectors of
another length than the query's are no candidates; a repeated row (same id and
vector) counts once; ties go to the smaller id; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.common import chunks_for, written

TABLES, FUNCTIONS, WIDTH, PROBES = 4, 6, 1.5, 220
BLOCK = 8192                    # index rows that are held in one task, about
SLICE = 64                      # queries multiplied at a time
CELLS = 1 << 8
SEED = 13


@cache
def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(dim, TABLES * FUNCTIONS)), rng.uniform(0, WIDTH, TABLES * FUNCTIONS)


@cache
def perturbations() -> np.ndarray:
    return np.array(list(product((-1, 0, 1), repeat=FUNCTIONS)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _code(cells: np.ndarray) -> np.ndarray:
    """One number for the cells of a table's functions (last axis)."""
    return ((cells + CELLS // 2) % CELLS) @ (np.int64(CELLS) ** np.arange(FUNCTIONS, dtype=np.int64))


def places(x: np.ndarray) -> np.ndarray:
    """Projections of vectors in cells: (vector, table, function)."""
    a, b = projections(x.shape[1])
    return ((unit_rows(x) @ a + b) / WIDTH).reshape(len(x), TABLES, FUNCTIONS)


def buckets(x: np.ndarray) -> np.ndarray:
    """(vector, table): the bucket of each."""
    return _code(np.floor(places(x)).astype(np.int64))


def probes(x: np.ndarray, most: int = PROBES) -> np.ndarray:
    """(vector, table, probe): buckets to visit, likeliest first."""
    at = places(x)
    cell = np.floor(at).astype(np.int64)
    inside = at - cell
    moves = perturbations()
    cost = (inside ** 2) @ (moves == -1).T.astype(float) + ((1 - inside) ** 2) @ (moves == 1).T.astype(float)
    order = np.argsort(cost, axis=-1, kind="stable")[..., :most]
    return _code(cell[:, :, None, :] + moves[order])


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _bucket_rows(of: str, most: int = PROBES):
    """mapInArrow over (k1, k2, dim, vector): rows (dim, table, bucket, k1, k2, vector), one for each bucket of a vector."""
    def make(batches):
        for batch in batches:
            for part in _by_dim(batch):
                x = _matrix(part.column("vector"), part.num_rows)
                for i in range(0, len(x), 512):
                    code = buckets(x[i:i + 512])[:, :, None] if of == "index" else probes(x[i:i + 512], most)
                    n, tables, each = code.shape
                    row = np.repeat(np.arange(i, i + n), tables * each)
                    table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), n)
                    take = part.take(pa.array(row)) if of == "index" else part.select(["k1", "k2", "dim"]).take(pa.array(row))
                    yield from take.append_column("table", pa.array(table)).append_column("bucket", pa.array(code.reshape(-1))) \
                                   .combine_chunks().to_batches()
    return make


def _by_dim(batch: pa.RecordBatch):
    """The batch's rows by vector length."""
    whole = pa.Table.from_batches([batch])
    dims = batch.column(batch.schema.names.index("dim")).to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        yield (whole if (dims == d).all() else whole.filter(pa.array(dims == d))).combine_chunks()


class _Block:
    """A block's index rows, ready for queries: unit vectors in the order of their buckets."""

    def __init__(self, rows: pa.Table):
        self.x = unit_rows(_matrix(rows.column("vector"), rows.num_rows))
        visit = rows.column("visit").to_numpy()
        order = np.argsort(visit, kind="stable")
        self.x, visit = self.x[order], visit[order]
        ids = rows.column("ids").to_pylist()
        self.ids = [ids[i] for i in order.tolist()]
        self.codes, first = np.unique(visit, return_index=True)
        self.from_, self.to = first, np.append(first[1:], len(visit))

    def search(self, queries: pa.Table, most: int) -> list[tuple]:
        """The best ``most`` ids of each query; only the buckets that it visits are multiplied."""
        out: list[tuple] = []
        q = unit_rows(_matrix(queries.column("vector"), queries.num_rows))
        q1, q2 = queries.column("k1").to_pylist(), queries.column("k2").to_pylist()
        visits = [None if v is None else self._places(v) for v in queries.column("visits").to_pylist()]
        for i in range(0, len(q), SLICE):
            part = visits[i:i + SLICE]
            goes = np.array([np.ones(len(self.codes), dtype=bool) if v is None else v for v in part])
            near = np.full((len(part), len(self.x)), -np.inf)
            for b in np.flatnonzero(goes.any(axis=0)).tolist():
                who = np.flatnonzero(goes[:, b])
                near[who, self.from_[b]:self.to[b]] = q[i + who] @ self.x[self.from_[b]:self.to[b]].T
            for k in range(len(part)):
                rows = np.flatnonzero(near[k] > -np.inf)
                if len(rows) > most:  # with a margin for rounding in the product
                    cosine = near[k, rows]
                    rows = rows[cosine >= np.partition(cosine, -most)[-most] - 1e-9]
                exact = np.einsum("ij,j->i", self.x[rows], q[i + k])
                best = sorted((-s, v) for s, r in zip(exact.tolist(), rows.tolist()) for v in self.ids[r])[:most]
                out += [(q1[i + k], q2[i + k], v, -s) for s, v in best]
        return out

    def _places(self, visits: list[int]) -> np.ndarray:
        return np.isin(self.codes, np.array(visits, dtype=np.int64))


def _search(most: int):
    """mapInArrow over rows sorted by (dim, block, kind): a block's index rows, kind 0, come before the queries that go
    there, kind 1. The index rows are held, the queries stream past them, however many they are."""
    schema = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meet(batches):
        at, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            keys = np.stack([whole.column(c).to_numpy() for c in ("dim", "block", "kind")], axis=1).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                dim, number, kind = keys[a].tolist()
                if at != (dim, number):
                    at, held, block = (dim, number), [], None
                part = whole.slice(a, b - a)
                if kind == 0:
                    held.append(part)
                elif held or block is not None:
                    if block is None:
                        block, held = _Block(pa.concat_tables(held).combine_chunks()), []
                    out = block.search(part.combine_chunks(), most)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return meet


def _met(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(q1, q2, vec_id, score): index rows ``left`` (dim, block, visit, vector, ids) and queries ``right`` (dim, block, k1, k2,
    vector, visits) meet in their blocks; either moves once."""
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["dim", "block", "kind", "visit", "ids", "k1", "k2", "visits", "vector"]
    rows = left.select("dim", "block", F.lit(0).alias("kind"), "visit", "ids", none("long").alias("k1"), none("long").alias("k2"),
                       none("array<long>").alias("visits"), "vector").select(*columns)
    asks = right.select("dim", "block", F.lit(1).alias("kind"), none("long").alias("visit"), none("array<long>").alias("ids"), "k1", "k2", "visits", "vector")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.unionByName(asks).repartition(n, "dim", "block").sortWithinPartitions("dim", "block", "kind") \
        .mapInArrow(_search(most), "q1 long, q2 long, vec_id long, score double")


def entries(vectors: DataFrame, keep: int) -> DataFrame:
    """(k1, k2, dim, vector, ids): different vectors, each with its ``keep`` smallest ids."""
    value = F.col("vector")
    rows = vectors.filter("vec_id is not null and vector is not null and size(vector) > 0").filter(
        F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(value, lambda v: v != 0))
    rows = rows.select("vec_id", "vector", F.size("vector").alias("dim"), F.xxhash64("vector").alias("k1"),
                       F.xxhash64(F.lit(1), "vector").alias("k2")).dropDuplicates(["k1", "k2", "vec_id"])
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    rows = rows.withColumn("nth", nth).filter(F.col("nth") <= keep)
    return rows.groupBy("k1", "k2", "dim").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
            probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``is_query`` (of the id) holds.

    ``probes``: buckets visited in each table. ``exact``: every query visits all buckets of one table, so the true nearest
    are found, at the price of comparing every query with every row."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"),
                          vectors[vector_column].cast(T.ArrayType(T.DoubleType())).alias("vector"))
    index = written(entries(rows, k + 1), "ann-entries")
    asked = rows.filter(is_query(F.col("vec_id"))).select(
        F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("q1"), F.xxhash64(F.lit(1), "vector").alias("q2")).distinct()
    asked = written(asked, "ann-queries")
    searched = index.join(asked.select(F.col("q1").alias("k1"), F.col("q2").alias("k2")).distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "dim", "vector")
    kind = "k1 long, k2 long, dim int"
    placed = index.mapInArrow(_bucket_rows("index"), f"{kind}, vector array<double>, ids array<long>, table int, bucket long")
    placed = written(placed, "ann-index")
    blocks = chunks_for(placed.count(), BLOCK)
    heavy = placed.groupBy("dim", "table", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
    heavy = written(heavy, "ann-buckets")
    visit = F.xxhash64("dim", "table", "bucket").alias("visit")
    block = F.pmod(F.xxhash64("dim", "table", "bucket", "cut"), F.lit(blocks)).alias("block")
    left = placed.join(heavy, ["dim", "table", "bucket"]).withColumn("cut", F.pmod(F.xxhash64("k1"), F.col("cuts")))
    left = left.select("dim", "table", block, visit, "vector", "ids")
    everywhere = lambda some: some.select(
        "k1", "k2", "dim", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.lit(None).cast("array<long>").alias("visits"))
    if exact:
        found = _met(left.filter("table = 0"), everywhere(searched), k + 1).groupBy("q1", "q2", "vec_id").agg(F.max("score").alias("score"))
        return _ranked(asked, found, k)
    visits = searched.mapInArrow(_bucket_rows("query", probes), f"{kind}, table int, bucket long").join(heavy, ["dim", "table", "bucket"])
    visits = visits.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    visits = visits.select("k1", "k2", block, visit).groupBy("k1", "k2", "block").agg(F.collect_set("visit").alias("visits"))
    right = visits.join(searched, ["k1", "k2"])
    found = written(_met(left, right, k + 1).groupBy("q1", "q2", "vec_id").agg(F.max("score").alias("score")), "ann-found")
    # Queries that met fewer than k rows (sparse surroundings, tiny tables) visit every bucket of one table.
    met = asked.join(found, ["q1", "q2"], "left").groupBy("query_id", "q1", "q2").agg(
        F.count(F.when(F.col("vec_id") != F.col("query_id"), 1)).alias("met"))
    short = met.filter(F.col("met") < k).select(F.col("q1").alias("k1"), F.col("q2").alias("k2")).distinct()
    rest = everywhere(short.join(searched, ["k1", "k2"]))
    more = _met(left.filter("table = 0"), rest, k + 1)
    return _ranked(asked, found.unionByName(more).groupBy("q1", "q2", "vec_id").agg(F.max("score").alias("score")), k)


def _ranked(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = asked.join(found, ["q1", "q2"]).filter("vec_id <> query_id").withColumn("rank", F.row_number().over(best))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
