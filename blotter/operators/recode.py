"""Dictionary recoding of long category vocabularies.

A dictionary is a table ``recode_dim(domain, raw, target)`` that the user
loads; it is data, not code.  :func:`recode` replaces every value of a
column found in one domain of that table by its target and passes every
other value (unmapped, NULL, other case) through unchanged: the semantics of
a chain of ``DataFrame.replace`` calls, in one join instead of one
projection per dictionary entry.

Scale: a dictionary is small next to the fact table, but its size is
*checked*, not assumed.  Up to ``max_broadcast_rows`` distinct keys it is
broadcast (no shuffle of the fact table, so a hot category that holds a third
of all rows costs nothing extra); above that it is joined by a shuffle join,
which AQE may still turn into a broadcast or split for skew at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 100_000

_RAW = "__recode_raw"
_TARGET = "__recode_target"


class DictionaryError(ValueError):
    """A dictionary maps one key to two targets, or has NULL keys/targets."""


def domain_entries(dim: DataFrame, domain: str) -> DataFrame:
    """Distinct (raw, target) entries of one domain."""
    return dim.filter(F.col("domain") == domain).select("raw", "target").distinct()


class CheckedDim:
    """A dictionary whose domains are validated when they are asked for.

    ``rows`` holds ``{domain: [(raw, target)]}`` when the whole dictionary is
    at most ``max_rows`` distinct entries (checked by fetching at most one
    more): it would be collected for the broadcast anyway, and each domain
    then enters the fact-table plan without a sub-plan to recompute.  A larger
    dictionary keeps ``df`` lazy.  The size chooses where the rules are
    checked, never the rules: only requested domains are validated, and a
    ``merged`` domain is one lookup by construction, so its targets may be keys.
    """

    def __init__(self, df: DataFrame, rows: dict[str, list[tuple]] | None, max_rows: int, merged: frozenset[str] = frozenset()):
        self.df = df
        self.rows = rows
        self.max_rows = max_rows
        self.merged = merged

    @property
    def local(self) -> dict[str, dict[str, str]] | None:
        """All domains, validated, of a small dictionary."""
        return None if self.rows is None else {d: self.mapping(d) for d in self.rows}

    def mapping(self, domain: str) -> dict[str, str]:
        return _validate(domain, (self.rows or {}).get(domain, []), domain not in self.merged)

    def has(self, domain: str) -> bool:
        if self.rows is not None:
            return domain in self.rows
        return not self.df.filter(F.col("domain") == domain).isEmpty()

    def entries(self, domain: str) -> tuple[DataFrame, int]:
        if self.rows is not None:
            m = self.mapping(domain)
            spark = self.df.sparkSession
            return spark.createDataFrame(list(m.items()), "raw string, target string"), len(m)
        return _check_distributed(self.df, domain, domain not in self.merged)


def _validate(domain: str, rows, chains: bool = True) -> dict[str, str]:
    m: dict[str, str] = {}
    for k, v in rows:
        if k is None or v is None:
            raise DictionaryError(f"domain {domain!r}: NULL key or target")
        if m.setdefault(k, v) != v:
            raise DictionaryError(f"domain {domain!r}: key {k!r} has two targets ({m[k]!r}, {v!r})")
    chained = [k for k, v in m.items() if v != k and v in m and m[v] != v] if chains else []
    if chained:
        raise DictionaryError(
            f"domain {domain!r}: target(s) of {chained[:5]} are keys with other targets; a chain of "
            "replaces would depend on entry order -- split the domain into passes (merge_passes)")
    return m


def check_dim(dim: DataFrame | CheckedDim,
              max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> CheckedDim:
    """A dictionary whose domains are validated on request; a small one is fetched in one job.

    A key repeated with the same target is de-duplicated (a repeated key
    would otherwise duplicate fact rows in the join).  A key with two
    targets, a NULL key or target, or a target that is itself a key with
    another target (a chain: the result of sequential replaces would depend
    on entry order; identity entries are fine) raises :class:`DictionaryError`.
    Without chains one lookup equals any order of sequential replaces.
    """
    if isinstance(dim, CheckedDim):
        return dim
    distinct = dim.select("domain", "raw", "target").distinct()
    head = distinct.limit(max_broadcast_rows + 1).collect()
    if len(head) <= max_broadcast_rows:
        rows: dict[str, list[tuple]] = {}
        for d, k, v in head:
            rows.setdefault(d, []).append((k, v))
        return CheckedDim(dim, rows, max_broadcast_rows)
    return CheckedDim(dim, None, max_broadcast_rows)


def _check_distributed(dim: DataFrame, domain: str, chained: bool = True) -> tuple[DataFrame, int]:
    entries = domain_entries(dim, domain)
    per_key = entries.groupBy("raw").agg(F.count(F.lit(1)).alias("n_targets"),
                                         F.count("target").alias("n_nonnull"))
    stats = per_key.agg(
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum((F.col("n_targets") > 1).cast("long")), F.lit(0)).alias("conflicts"),
        F.coalesce(F.sum((F.col("raw").isNull() | (F.col("n_nonnull") < F.col("n_targets"))).cast("long")),
                   F.lit(0)).alias("nulls"),
    ).first()
    if stats["conflicts"]:
        bad = [r["raw"] for r in per_key.filter(F.col("n_targets") > 1).select("raw").limit(5).collect()]
        raise DictionaryError(f"domain {domain!r}: {stats['conflicts']} key(s) with two targets, e.g. {bad}")
    if stats["nulls"]:
        raise DictionaryError(f"domain {domain!r}: NULL key or target")
    if not chained:
        return entries, int(stats["keys"])
    e2 = entries.select(F.col("raw").alias("r2"), F.col("target").alias("t2"))
    chains = (entries.filter(F.col("raw") != F.col("target"))
                     .join(e2, (F.col("target") == F.col("r2")) & (F.col("t2") != F.col("r2")), "left_semi"))
    bad = [r["raw"] for r in chains.select("raw").limit(5).collect()]
    if bad:
        raise DictionaryError(f"domain {domain!r}: targets of {bad} are keys with other targets")
    return entries, int(stats["keys"])


def dim_check(dim: DataFrame | CheckedDim, domain: str,
              max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """Validated, de-duplicated entries of one domain and their key count."""
    return check_dim(dim, max_broadcast_rows).entries(domain)


def recode(df: DataFrame, column: str, dim: DataFrame | CheckedDim, domain: str,
           max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
           output: str | None = None) -> DataFrame:
    """Replace ``column`` values found in ``domain`` of ``dim``; pass others through.

    Exact and case-sensitive; NULL stays NULL (a join never matches NULL);
    the row count never changes (keys are unique after validation).
    """
    entries, n_keys = dim_check(dim, domain, max_broadcast_rows)
    right = entries.select(F.col("raw").alias(_RAW), F.col("target").alias(_TARGET))
    if n_keys <= max_broadcast_rows:
        right = F.broadcast(right)
    joined = df.join(right, F.col(column) == F.col(_RAW), "left")
    out = output or column
    return (joined.withColumn(out, F.coalesce(F.col(_TARGET), F.col(column)))
                  .drop(_RAW, _TARGET))


def recode_many(df: DataFrame, dim: DataFrame | CheckedDim, columns: dict[str, str],
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Recode several columns ``{column: domain}``; all broadcast joins fuse into one stage."""
    checked = check_dim(dim, max_broadcast_rows)
    for column, domain in columns.items():
        df = recode(df, column, checked, domain, max_broadcast_rows)
    return df


def recode_literal(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Same semantics for a tiny in-code dictionary: one ``replace`` projection, no join."""
    return df.replace(mapping, subset=[column]) if mapping else df


def merge_passes(dim: DataFrame | CheckedDim, first: str, second: str,
                 into: str | None = None,
                 max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> CheckedDim:
    """Fold two sequential passes into one dictionary with the same result.

    Applying ``first`` then ``second`` maps a value ``v`` to
    ``second(first(v))`` where each pass passes unmapped values through.  The
    merged domain holds every first-pass key (its target chained through
    the second pass) and every second-pass key the first pass does not know.
    The merged domain is stored as ``into`` (default: ``first``, replacing it).
    """
    into = into or first
    dim = check_dim(dim, max_broadcast_rows)
    merged_names = dim.merged | {into}
    if dim.rows is not None:
        p1, p2 = dim.mapping(first), dim.mapping(second)
        merged = {k: p2.get(v, v) for k, v in p1.items()}
        merged.update({k: v for k, v in p2.items() if k not in p1})
        return CheckedDim(dim.df, {**dim.rows, into: list(merged.items())}, dim.max_rows, merged_names)
    for name in (first, second):
        dim.entries(name)                      # each pass by the same rules as on the local path
    max_rows, dim = dim.max_rows, dim.df
    p1 = domain_entries(dim, first).select(F.col("raw").alias("r1"), F.col("target").alias("t1"))
    p2 = domain_entries(dim, second).select(F.col("raw").alias("r2"), F.col("target").alias("t2"))
    chained = (p1.join(p2, p1.t1 == p2.r2, "left")
                 .select(F.col("r1").alias("raw"), F.coalesce("t2", "t1").alias("target")))
    only2 = (p2.join(p1, p2.r2 == p1.r1, "left_anti")
               .select(F.col("r2").alias("raw"), F.col("t2").alias("target")))
    merged = chained.unionByName(only2).select(F.lit(into).alias("domain"), "raw", "target")
    rest = dim.filter(F.col("domain") != into)
    return CheckedDim(rest.unionByName(merged), None, max_rows, merged_names)


def coverage(df: DataFrame, column: str, dim: DataFrame | CheckedDim, domain: str,
             max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Observed non-NULL values with no dictionary entry: (``value``, ``n``).

    Counted first (partial aggregation, so a hot value is one row per task),
    then anti-joined against the key set (broadcast when its checked size allows).
    """
    entries, n_keys = dim_check(dim, domain, max_broadcast_rows)
    keys = entries.select(F.col("raw").alias(_RAW))
    if n_keys <= max_broadcast_rows:
        keys = F.broadcast(keys)
    counts = (df.filter(F.col(column).isNotNull())
                .groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    return counts.join(keys, F.col("value") == F.col(_RAW), "left_anti")


def coverage_many(df: DataFrame, dim: DataFrame | CheckedDim, columns: dict[str, str],
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Unmapped values of several columns in one pass: (``domain``, ``value``, ``n``).

    The fact table is unpivoted to (domain, value), counted once (partial
    aggregation per task), then anti-joined with the dictionary keys.
    """
    dim = check_dim(dim, max_broadcast_rows)
    key_sets = []
    total = 0
    for domain in dict.fromkeys(columns.values()):
        entries, n = dim_check(dim, domain, max_broadcast_rows)
        total += n
        key_sets.append(entries.select(F.lit(domain).alias("__d"), F.col("raw").alias(_RAW)))
    keys = key_sets[0]
    for k in key_sets[1:]:
        keys = keys.unionByName(k)
    if total <= max_broadcast_rows:
        keys = F.broadcast(keys)
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(c).alias("value"))
                                for c, d in columns.items()]))
    counts = (df.select(pairs.alias("p")).select("p.domain", "p.value")
                .filter(F.col("value").isNotNull())
                .groupBy("domain", "value").agg(F.count(F.lit(1)).alias("n")))
    cond = (F.col("domain") == F.col("__d")) & (F.col("value") == F.col(_RAW))
    return counts.join(keys, cond, "left_anti")


def dim_profile(dim: DataFrame) -> DataFrame:
    """Per domain: entries (with repeats), distinct keys, distinct targets."""
    return dim.groupBy("domain").agg(
        F.count(F.lit(1)).alias("entries"),
        F.countDistinct("raw").alias("keys"),
        F.countDistinct("target").alias("targets"),
    )


def coverage_from_counts(value_counts: DataFrame, dim: DataFrame | CheckedDim, columns: dict[str, str],
                         max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """:func:`coverage_many` from precomputed (``column_name``, ``value``, ``n``) counts.

    Same rows as ``coverage_many(df, dim, columns)`` when the counts were taken
    over ``df`` (see :class:`blotter.operators.profile.ValueCounts`).
    """
    dim = check_dim(dim, max_broadcast_rows)
    key_sets, total = [], 0
    for domain in dict.fromkeys(columns.values()):
        entries, n = dim_check(dim, domain, max_broadcast_rows)
        total += n
        key_sets.append(entries.select(F.lit(domain).alias("__d"), F.col("raw").alias(_RAW)))
    keys = key_sets[0]
    for k in key_sets[1:]:
        keys = keys.unionByName(k)
    if total <= max_broadcast_rows:
        keys = F.broadcast(keys)
    domain_of = F.create_map(*[x for c, d in columns.items() for x in (F.lit(c), F.lit(d))])
    counts = (value_counts.filter(F.col("column_name").isin(*columns) & F.col("value").isNotNull())
                          .select(domain_of[F.col("column_name")].alias("domain"), "value", "n")
                          .groupBy("domain", "value").agg(F.sum("n").alias("n")))
    cond = (F.col("domain") == F.col("__d")) & (F.col("value") == F.col(_RAW))
    return counts.join(keys, cond, "left_anti")
