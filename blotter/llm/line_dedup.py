"""Lines that stand in many documents, found through levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z
lower-cased; its hash is the 128-bit BLAKE2b of the key.  Batches of documents
are added one after another to a :class:`LineRuns`:

* a run is a bucketed table sorted by hash: (h1, h2, docs), docs being the
  number of documents of its batches that hold the line;
* a new batch is counted (partial counts in every map task, so a line of a third
  of all documents is one row per task), merge-anti-joined with the keys that the
  runs have settled already (``docs`` of one run reaches the threshold), and
  what is left becomes a run of level 0;
* ``FAN`` runs of one level are compacted to one of the next, adding the counts.

All runs have the same buckets, so neither the anti-join nor a compaction (a
full outer merge join) shuffles a run.  The lines whose counts over all runs reach the threshold are
then dropped from all documents.  Up to ``BROADCAST_KEYS`` of them (16 bytes
each, counted first) are broadcast; more are joined with the documents' lines,
salted, and the texts meet their own dropped lines by the text's hash.

Defined cases: a null or empty text is one empty line; an empty key (white space
only) is never dropped; a line repeated in one document counts once; every row is
a document, so repeated rows count each; null ids are kept; an empty table gives
no rows.  Texts are handled whole, one at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm.common import boxed, remove, text_of, written
from blotter.session import shared_dir

#: Documents that must hold a line before it goes.
LEAST = 10
#: Runs of one level that are merged to one of the next.
FAN = 3
#: Batches that a whole table is added in.
BATCHES = 6
#: Dropped lines that are broadcast at most (16 bytes each).
BROADCAST_KEYS = 1_000_000
#: Ways in which a frequent line's or text's rows are dealt when they are joined.
SALT = 16

_ENDS = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(_ENDS).lower() for line in text.split(b"\n")]


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for t in column.cast(pa.large_string()).cast(pa.large_binary()):
        yield t.as_py() or b""


def line_digests(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, h1, h2): one row for each document and different line of it."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch, text in zip(part.column(0).to_pylist(), _texts(part.column(1))):
                found = _pairs([_digest(k) for k in {k for k in line_keys(text) if k}])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), batch, dtype=np.int32)), pa.array(found[:, 0]),
                                                      pa.array(found[:, 1])], names=["batch", "h1", "h2"])

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for out in run(parts):
            held.append(out)
            rows += out.num_rows
            if rows > 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    number = F.pmod(F.xxhash64(docs["doc_id"], docs["text"]), F.lit(batches)).cast("int")
    return docs.select(number.alias("batch"), text_of(docs).alias("text")).mapInArrow(joined, "batch int, h1 long, h2 long")


class LineRuns:
    """Runs of line hashes on the shared folder, in levels; see the module's text."""

    def __init__(self, spark: SparkSession, least: int = LEAST, fan: int = FAN, buckets: int | None = None):
        self.spark, self.least, self.fan = spark, least, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_dir(self.spark, "line-run")
        (rows.select("h1", "h2", "docs").write.format("parquet").option("path", self.paths[name])
         .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name))
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        # Sorted runs are merged pair by pair as full outer joins. (A union of bucketed tables must not be grouped without an
        # exchange: Spark 4.1 takes the union for co-partitioned even where it then reads the tables unbucketed.)
        rows = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnRenamed("docs", "more")
            rows = rows.join(more, ["h1", "h2"], "full") \
                .select("h1", "h2", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
        return rows

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, digests: DataFrame) -> None:
        """One batch: (h1, h2), a row for each document and different line."""
        own = digests.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
        for name in self.runs():
            own = own.join(self.spark.table(name).filter(F.col("docs") >= self.least), ["h1", "h2"], "left_anti")
        self._put(self._write(own), 0)

    def _put(self, name: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan:
            olds = self.levels[level]
            self.levels[level] = []
            self._put(self._write(self._merged(olds)), level + 1)
            self._drop(olds)

    def frequent(self) -> DataFrame:
        """(h1, h2) of the lines that the threshold of documents holds, written to the shared folder."""
        found = self._merged(self.runs()).filter(F.col("docs") >= self.least).select("h1", "h2")
        return written(found, "line-frequent")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = []


def frequent_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """(h1, h2) of the lines of at least ``least`` documents."""
    spark = docs.sparkSession
    digests = written(line_digests(docs, batches), "line-digests", partition="batch")
    runs = LineRuns(spark, least)
    for batch in range(batches):
        runs.add(digests.filter(F.col("batch") == batch))
    found = runs.frequent()
    runs.close()
    return found


class _Sorted:
    """Membership in sorted 128-bit hashes, exact: equal first halves are told apart by their second ones."""

    def __init__(self, pairs: np.ndarray):
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        self.h1, self.h2 = np.ascontiguousarray(pairs[order, 0]), np.ascontiguousarray(pairs[order, 1])

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), dtype=bool)
        if not len(self.h1):
            return out
        at = np.searchsorted(self.h1, pairs[:, 0])
        left = np.arange(len(pairs))
        while len(left):
            left = left[at[left] < len(self.h1)]
            left = left[self.h1[at[left]] == pairs[left, 0]]
            out[left] = self.h2[at[left]] == pairs[left, 1]
            left = left[~out[left]]
            at[left] += 1
        return out


def _rewrite(docs: DataFrame, drops_of) -> DataFrame:
    """``row, text, *more`` -> ``row`` with n_lines, n_dropped, kept; ``drops_of`` maps a batch to a test of (digests, row)."""
    schema = T.StructType([docs.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                           T.StructField("kept", T.StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            test = drops_of(part)
            total, gone, kept = [], [], []
            for i, text in enumerate(_texts(part.column("text"))):
                lines = text.split(b"\n")
                at = [j for j, line in enumerate(lines) if line.strip(_ENDS)]
                hit = test(_pairs([_digest(lines[j].strip(_ENDS).lower()) for j in at]), i) if at else np.zeros(0, dtype=bool)
                out = {j for j, h in zip(at, hit.tolist()) if h}
                total.append(len(lines))
                gone.append(len(out))
                kept.append(b"\n".join(line for j, line in enumerate(lines) if j not in out) if out else text)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())],
                                             names=["row", "n_lines", "n_dropped", "kept"])

    return docs.mapInArrow(run, schema)


def without_frequent(docs: DataFrame, frequent: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``row`` (all columns of ``docs``), n_lines, n_dropped, kept (the text of the other lines)."""
    own = boxed(docs, text=text_of(docs))
    if frequent.count() <= broadcast_keys:
        keys = frequent.toArrow()
        pairs = np.stack([keys.column(c).to_numpy() for c in ("h1", "h2")], axis=1).astype(np.int64).reshape(-1, 2)
        shared = docs.sparkSession.sparkContext.broadcast(pairs)
        state: dict[str, _Sorted] = {}

        def small(part: pa.RecordBatch):
            if "keys" not in state:
                state["keys"] = _Sorted(shared.value)
            return lambda digests, i: state["keys"](digests)

        return _rewrite(own, small)

    # Too many to broadcast: the documents' lines meet the frequent ones, salted, and each text its own by its hash.
    marked = boxed(docs, text=text_of(docs)).withColumn("_text", F.sha2("text", 256)).withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int"))

    def lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for key, text in zip(part.column(0).to_pylist(), _texts(part.column(1))):
                found = _pairs([_digest(k) for k in {k for k in line_keys(text) if k}])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found)), pa.array(found[:, 0]), pa.array(found[:, 1])],
                                                     names=["_text", "h1", "h2"])

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    held = marked.select("_text", "text").mapInArrow(lines, "_text string, h1 long, h2 long") \
        .withColumn("s", F.pmod(F.xxhash64("_text"), F.lit(SALT)).cast("int"))
    drops = held.join(frequent.withColumn("s", salts), ["h1", "h2", "s"]).groupBy("_text") \
        .agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    met = marked.join(drops.withColumn("_salt", salts), ["_text", "_salt"], "left").select("row", "text", "drops")

    def large(part: pa.RecordBatch):
        drops = part.column("drops")

        def test(digests: np.ndarray, i: int) -> np.ndarray:
            mine = drops[i].as_py()
            if not mine:
                return np.zeros(len(digests), dtype=bool)
            return _Sorted(np.array([(d["h1"], d["h2"]) for d in mine], dtype=np.int64))(digests)

        return test

    return _rewrite(met, large)


def line_report(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``row``, n_lines, n_dropped and kept of every document, without the lines of at least ``least`` documents."""
    return without_frequent(docs, frequent_lines(docs, least, batches), broadcast_keys)
