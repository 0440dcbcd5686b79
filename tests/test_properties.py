"""Property tests (hypothesis): operators against brute force on random small inputs."""
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from blotter.operators.classify import MIX_MODULUS, MIX_MULTIPLIER, split_bucket
from blotter.operators.recode import recode
from blotter.operators.trends import top_k
from blotter.sources.dims import recode_dim

SETTINGS = settings(max_examples=15, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
WORDS = st.sampled_from(["a", "b", "c", "A", "null", "x y", "", "Ünï"])


@st.composite
def dictionaries(draw):
    """Random dictionaries without chains (a target is never another key with another target)."""
    keys = draw(st.lists(WORDS, unique=True, max_size=5))
    targets = st.sampled_from(["T1", "T2", "T3"])
    m = {k: draw(targets) for k in keys}
    return m


@SETTINGS
@given(mapping=dictionaries(), values=st.lists(st.one_of(st.none(), WORDS), max_size=30))
def test_recode_equals_sequential_replace(spark, mapping, values):
    facts = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, c string")
    want = {i: mapping.get(v, v) if v is not None else None for i, v in enumerate(values)}
    dim = recode_dim(spark, {"d": mapping}) if mapping else recode_dim(spark, [("d", "zz", "zz")])
    got = {r.id: r.c for r in recode(facts, "c", dim, "d").collect()}
    assert got == want


@SETTINGS
@given(values=st.lists(st.one_of(st.none(), st.sampled_from("pqrstu")), min_size=1, max_size=60),
       k=st.integers(min_value=1, max_value=4))
def test_top_k_equals_sorted_counts(spark, values, k):
    df = spark.createDataFrame([(v,) for v in values], "k string")
    counts = Counter(values)
    want = sorted(counts.items(), key=lambda kv: (-kv[1], (kv[0] is not None, kv[0] or "")))[:k]
    assert [tuple(r) for r in top_k(df, "k", k).collect()] == want


def _bucket(key: int, salt: int = 0) -> int:
    h = (key % MIX_MODULUS + salt) % MIX_MODULUS
    h = h * MIX_MULTIPLIER % MIX_MODULUS
    h = h * MIX_MULTIPLIER % MIX_MODULUS
    return h % 100


@SETTINGS
@given(keys=st.lists(st.integers(min_value=-(2 ** 63), max_value=2 ** 63 - 1), min_size=1, max_size=40),
       salt=st.integers(min_value=0, max_value=1000))
def test_split_bucket_matches_arithmetic_without_overflow(spark, keys, salt):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r.b for r in df.select(split_bucket("k", salt).alias("b")).collect()]
    assert got == [_bucket(k, salt) for k in keys]


@pytest.mark.parametrize("n", [10_000])
def test_split_is_balanced(spark, n):
    df = spark.range(0, n).withColumnRenamed("id", "k")
    train = df.filter(split_bucket("k") < 80).count()
    assert abs(train / n - 0.8) < 0.02
