"""The registered queries of this subpackage: ``opN_<name>`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm.common import table
from blotter.llm.oracle import ORACLE_SQL  # noqa: F401  (registered beside the queries)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.license_scan import license_report
    return license_report(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.mixing import mix_table
    return mix_table(table(spark, sf_dir, "documents"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.sharding import shard_table
    return shard_table(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.minhash import edited_table
    return edited_table(table(spark, sf_dir, "documents"), classes=True)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.ann import nearest
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.substrings import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.quality import graded, ratings_of
    scored = graded(table(spark, sf_dir, "documents").select("doc_id", "text"), ratings_of(table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", "expected_grade", "tail", "keep")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.simhash import hex_fingerprint, near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.line_dedup import line_report
    return line_report(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.prefix_trie import conversation_trie
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blotter.llm.lexical import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_mix_sources, op3_pack, op4_nearest, op5_fingerprint, op6_toxicity,
                            op7_suffix_dedup, op8_quality, op9_shard, op10_simhash, op11_line_dedup, op12_prefix_trie,
                            op13_lexical_search, pipeline)
}
