"""Incident analytics on Spark.

Composable ``DataFrame -> DataFrame`` operators for large tables of dated,
located, categorised incidents: all-string CSV ingest, profiling, date/time
normalisation, safe casts, dictionary recoding through a broadcast
dimension, NULL-explicit filters, a year-partitioned Parquet layer,
top-k / trend / demographic aggregates, frequent itemsets and association
rules, and a random-forest classification pipeline.

Sub-packages:

* ``sources``   – CSV / Parquet readers and writers, dimension tables,
                  the stand-in incident table built from the test tables.
* ``functions`` – column expressions (date/time text, casts, names).
* ``operators`` – profile, clean, recode, trends, patterns, classify.
* ``plans``     – end-to-end flows and the registered queries.
* ``streaming`` – the cleaning flow as a Structured Streaming job.
"""

__all__ = ["schema", "session"]
