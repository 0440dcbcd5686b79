"""Line dedup, conversation trie and ranked search against brute force and on odd input."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.llm import lexical, line_dedup, prefix_trie
from blotter.llm.common import lookup, written


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- op11 ----------------------------------------------------------------------
def lines_by_hand(rows, least):
    keys = lambda t: [line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for line in (t or "").split("\n")]
    held = Counter(k for _, t, _ in rows for k in set(keys(t)) if k)
    out = []
    for i, t, _ in rows:
        kept = [line for line, k in zip((t or "").split("\n"), keys(t)) if not (k and held[k] >= least)]
        n = len((t or "").split("\n"))
        out.append((i, n, n - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lines_of(df):
    return sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows_of(df)), key=str)


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_lines_equal_brute_force(documents, odd, broadcast_keys):
    rng = np.random.default_rng(11)
    some = ["  Shared Footer\t", "shared footer", "ÉTÉ", "été", "", "   ", "other line", "\x0bcookie\x0c", "COOKIE", *(f"line {i}" for i in range(40))]
    rows = odd + [(100 + i, "\n".join(rng.choice(some, rng.integers(0, 9))), "a") for i in range(120)]
    rows += [(7, "hot line\nown", "b")] * 60                      # a third of all rows are one row
    docs = documents(rows, clashing=True)
    assert lines_of(line_dedup.line_report(docs, least=10, batches=4, broadcast_keys=broadcast_keys)) == lines_by_hand(rows, 10)


def test_lines_keep_the_rows_columns(documents):
    docs = documents([(i, "same\nown", "a") for i in range(12)], clashing=True).withColumn("n_lines", F.lit("mine")).withColumn("kept", F.lit("too"))
    got = rows_of(line_dedup.line_report(docs, batches=2))
    assert all(r["row"]["n_lines"] == "mine" and r["row"]["kept"] == "too" and r["n_dropped"] == 2 for r in got)


def test_no_documents_no_lines(documents):
    assert rows_of(line_dedup.line_report(documents([]), batches=2)) == []


def test_runs_are_levelled_and_count_exactly(spark):
    runs = line_dedup.LineRuns(spark, least=5, fan=2, buckets=4)
    total, shapes = Counter(), []
    for b in range(6):
        keys = [(k, k * 7) for k in range(60) for _ in range((k + b) % 3)]
        total.update(keys)
        runs.add(spark.createDataFrame(keys, "h1 long, h2 long"))
        shapes.append([len(level) for level in runs.levels])
    assert shapes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1]]
    assert {(r.h1, r.h2) for r in runs.frequent().collect()} == {k for k, n in total.items() if n >= 5}
    tables = runs.runs()
    runs.close()
    assert not any(spark.catalog.tableExists(t) for t in tables)


def test_a_run_is_merged_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, fan=9, buckets=4)
    for b in range(2):
        runs.add(spark.range(50).selectExpr("id as h1", "id as h2"))
    plan = runs._merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
    runs.close()
    assert "FullOuter" in plan and "Exchange" not in plan


def test_equal_first_halves_are_told_apart():
    test = line_dedup._Sorted(np.array([(1, 5), (1, 2), (1, 9), (4, 4)], dtype=np.int64))
    asked = np.array([(1, 2), (1, 3), (1, 9), (1, 10), (4, 4), (4, 5), (0, 0), (9, 9)], dtype=np.int64)
    assert test(asked).tolist() == [True, False, True, False, True, False, False, False]


# --- op12 ----------------------------------------------------------------------
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType())])


def trie_by_hand(rows):
    turns = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[c].append((role or "", text or ""))
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    below = lambda p: [q for q in members if q[:len(p)] == p]
    saved = lambda q: (len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
    leaf = lambda q: not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in members)
    out = []
    for p, who in members.items():
        ends = sorted(c for c in who if len(rebuilt[c]) == len(p))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), sum(len(x) == len(p) + 1 and x[:len(p)] == p for x in members),
                    sum(map(leaf, below(p))), sum(map(saved, below(p))), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def some_turns(seed, convs=70, words=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        text = lambda: " ".join(rng.choice(["a", "b", "c\t"][:words], rng.integers(0, 3)))
        rows += [(c, int(t) if t else None, ["user", None][t % 2], text()) for t in range(int(rng.integers(1, 7)))]
    rows += [(5, 99, None, None), (5, 99, "user", "tie"), (5, 99, "user", "tie"), (None, 1, "user", "nobody"), (-3, 0, "user", "a"), (1000, 0, "user", "x")]
    return rows


@pytest.mark.parametrize("local", [20_000, 6])
def test_trie_equals_brute_force(spark, local):
    rows = some_turns(local)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("conv", "depth", "rank", "words", "key", "n")})
    got = [tuple(r) for r in prefix_trie.conversation_trie(df, local=local).collect()]
    assert sorted(got, key=str) == trie_by_hand(rows)


def test_trie_of_one_long_conversation_and_copies(spark):
    """A third of all rows in one conversation, a third in copies of another one; long chains are split by Spark rounds."""
    rows = [(40, t, "user", f"t{t}") for t in range(60)] + [(100 + c, t, "user", f"same{t}") for c in range(12) for t in range(5)]
    got = [tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS), local=25).collect()]
    assert sorted(got, key=str) == trie_by_hand(rows)


def test_no_turns_no_trie(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_centroid_totals_equal_plain_sums(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 200))
    parent = [-1 if i == 0 or rng.random() < 0.03 else int(rng.integers(max(0, i - (1 if seed % 3 == 0 else i)), i)) for i in range(n)]
    values = [rng.integers(0, 9, n).tolist(), rng.integers(-5, 5, n).tolist()]
    want = [v[:] for v in values]
    for i in reversed(range(n)):
        if parent[i] >= 0:
            for v in want:
                v[parent[i]] += v[i]
    prefix_trie.centroid_totals(parent, values)
    assert values == want


def test_long_conversations_are_numbered_over_partitions(spark):
    turns = spark.range(5000).selectExpr("1 as conv", "cast(pmod(id * 7919, 5000) as bigint) as turn", "'u' as role", "cast(id as string) as text")
    got = prefix_trie.numbered(turns.union(spark.sql("select 2L, 0L, 'u', 'x'")))
    assert sorted(r["rank"] for r in rows_of(got.filter("conv = 1"))) == list(range(1, 5001))
    checked = turns.select("turn", F.sha2(F.concat(F.lit("1:u"), "text"), 256).alias("turn_hash")).join(got, "turn_hash")
    assert checked.filter("rank <> turn + 1").count() == 0


def test_lookup_joins_hot_and_cold_keys(spark):
    left = written(spark.range(3000).selectExpr("case when id % 3 = 0 then -1 when id % 50 = 1 then null else id end as k", "id"), "left")
    right = spark.range(-1, 2000).selectExpr("id as k", "id * 2 as v")
    want = Counter(map(tuple, left.join(right, "k", "left").select("k", "id", "v").collect()))
    assert Counter(map(tuple, lookup(left, right, ["k"]).select("k", "id", "v").collect())) == want


# --- op13 ----------------------------------------------------------------------
def ranked_by_hand(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    counts = [Counter(split(t)) for _, t, _ in docs]
    n_docs, length = sum(map(bool, counts)), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _, _), c in zip(docs, counts):
            if c:
                m = 25 + (75 * c.total() * n_docs) // length
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text))
                if s > 0:
                    scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, documents, odd):
    rng = np.random.default_rng(13)
    vocabulary = ["the", "of", "Été", "WORD1", "don't", *(f"w{i}" for i in range(300))]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=p / p.sum()))
    rows = odd + [(1000 + i, text(int(rng.integers(1, 60))), "a") for i in range(400)] + [(50, "the w299 copy of all", "b")] * 200
    items = [(i, text(int(rng.integers(1, 30)))) for i in range(30)] + [(40, None), (41, ""), (42, "nothing-like-it zzz"), (None, "w299"), (43, "the the w1")]
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    for block, leaf in ((1 << 20, 8), (200, 48)):
        got = [tuple(r) for r in lexical.search(documents(rows, clashing=True), asked, block_bytes=block, leaf=leaf).collect()]
        assert sorted(got, key=str) == ranked_by_hand(rows, items)


def test_search_over_nothing(spark, documents):
    asked = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical.search(documents([]), asked).collect() == []
    assert lexical.search(documents([(1, None, "a"), (2, "...", "a")]), asked).collect() == []
    assert lexical.search(documents([(1, "word", "a")]), asked.limit(0)).collect() == []


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"Wörd{i % 97}-x" for i in range(5000)).encode()
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE", 64)
    assert lexical.term_counts(text) == whole and whole.total() == 10_000


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_and_prune(seed):
    rng = np.random.default_rng(seed)
    groups = rng.integers(0, 20, 600)
    docs = [np.unique(np.concatenate((rng.integers(20 * g, 20 * g + 20, 8), rng.integers(0, 400, 2)))) for g in groups]
    ends = np.concatenate(([0], np.cumsum(list(map(len, docs)))))
    value = rng.integers(1, 10**10, ends[-1])
    tree = lexical.BallTree(ends, np.concatenate(docs), value, 400, leaf=16)
    dense, visited, leaves = np.zeros(400, dtype=np.int64), 0, sum(x < 0 for x in tree.left)
    matrix = np.zeros((600, 400), dtype=np.int64)
    for i, d in enumerate(docs):
        matrix[i, d] = value[ends[i]:ends[i + 1]]
    for _ in range(20):
        g = int(rng.integers(0, 20))
        terms, counts = np.arange(20 * g, 20 * g + 10), rng.integers(1, 4, 10)
        exact = matrix[:, terms] @ counts
        for node, bound in enumerate(tree.bounds(terms, counts)):
            assert bound >= exact[tree.order[tree.low[node]:tree.high[node]]].max()
        best = []
        visited += tree.search(terms, counts, dense, list(range(600)), best, 10)
        assert sorted(s for s, _, _ in best) == sorted(exact)[-10:]
    assert visited < 0.5 * leaves * 20
