"""Hash collisions, hot rows and hubs, clashing names, long texts and what the operators leave behind."""
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from blotter.llm import ann, components, license_scan, minhash, mixing, packing, quality, sharding, simhash, substrings, suffixes, textbytes, toxicity
from blotter.llm.common import lookup, scope, tidy, written
from tests.llm.conftest import CLASHING


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


# --- hashes are compared, or cannot be made to collide by patterns ---------------
@pytest.fixture(scope="module")
def coder():
    pytest.importorskip("public_tokenizers")
    from blotter.llm.bpe import Encoder
    return Encoder(packing.vocabulary_path())


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_pieces_of_one_hash_get_their_own_ids(coder, n):
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    texts = [one, two, f"{two} {one} {two}", "x " + one]
    want = [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in coder.encode(texts)] == want            # in one call
    assert [coder.encode([t])[0].tolist() for t in texts] == want       # and against what is kept


def test_long_random_pieces(coder):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcé"), int(rng.integers(1, 3000)))) for _ in range(60)] * 2
    assert [x.tolist() for x in coder.encode(texts)] == [x.ids for x in coder.library.encode_batch(texts, add_special_tokens=False)]


def test_word_hashes_follow_the_word_alone():
    words = [thue_morse(1024), thue_morse(1024, "b", "a"), thue_morse(4096), thue_morse(4096, "b", "a"), "a", "b", "ab", "ba", "aa", "a"]
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    start, end, _ = textbytes.words(data, np.array([0, len(data)]))
    h = textbytes.word_hashes(data, start, end).tolist()
    assert len(set(h)) == len(set(words)) and h[4] == h[9]


def test_suffix_names_are_compared():
    for s in (thue_morse(512) + "c" + thue_morse(512, "b", "a"), thue_morse(300) * 2, "ab" * 200 + "ba" * 200):
        symbols = np.append(np.frombuffer(s.encode(), dtype=np.uint8).astype(np.int64) - 90, 0)
        assert suffixes.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())


# --- MinHash, independently ----------------------------------------------------------
def test_signatures_equal_a_scalar_minhash():
    """Word by word and permutation by permutation, in Python numbers."""
    texts = ["one two three four five six seven", "one  two\tthree four five six SEVEN", "short text", "", "É a b c d e f g É a b c d"]
    a, b = (x.tolist() for x in minhash.permutations())
    mask = (1 << 64) - 1

    def spread(h):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        return h ^ (h >> 31)

    def word(w):
        each = (spread(((c + 1) * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) & mask) for i, c in enumerate(w))
        return spread((sum(each) + len(w)) & mask)

    def shingles(text):
        w = [word(x) for x in text.encode().split()]
        runs = [w[i:i + 5] for i in range(len(w) - 4)] or ([w] if w else [])
        for run in runs:
            h = 0
            for x in run:
                h = (h * 0x100000001B3 + x) & mask
            yield spread(h if len(run) == 5 else (h + len(run)) & mask)

    different = np.zeros(len(texts), dtype=np.int64)
    got = minhash.signatures([t.encode() for t in texts], different=different)
    for t, row, n in zip(texts, got.tolist(), different.tolist()):
        x = set(shingles(t))
        assert n == len(x)
        assert row == [min(((h * p + q) & mask for h in x), default=mask) >> 32 for p, q in zip(a, b)]


# --- hot rows and hubs -----------------------------------------------------------------
def test_repeated_rows_are_dealt_to_many_chunks(documents):
    """A third of 20,000 rows are one row: no chunk of the first level holds much more than its share."""
    rows = [(1, "the same words", "s")] * 6700 + [(i, f"w{i} " * (i % 5 + 1), "s") for i in range(2, 13_300)]
    sized = mixing.sizes(documents(rows))
    seen = mixing.numbered(sized)
    assert seen.count() == len(rows)
    assert sorted(r.nth for r in seen.filter("doc_id = 1").collect()) == list(range(6700))
    chunks = Counter(r.c for r in seen.select(F.pmod(F.xxhash64(F.xxhash64(F.lit(7), "doc_id", "text_key", "size", "nth")), F.lit(100)).alias("c")).collect())
    assert max(chunks.values()) <= 1.6 * len(rows) / 100
    got = rows_of(mixing.mix_table(documents(rows)))
    assert len(got) == len(rows) and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 3


def test_hubs_of_components_are_broadcast(spark):
    """One node with two thirds of all links, chains, and pairs."""
    edges = [(0, i) for i in range(1, 2001)] + [(3000 + i, 3001 + i) for i in range(300)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(300)]
    got = dict(components.components(spark.createDataFrame(edges + edges[:50], "u long, v long")).collect())
    want = {i: 0 for i in range(2001)} | {3000 + i: 3000 for i in range(301)} | {x: 5000 + 2 * (x - 5000 >> 1) for x in range(5000, 5600)}
    assert got == want
    left = written(spark.createDataFrame([(0,)] * 4000 + [(i,) for i in range(1, 2000)], "u long"), "left")
    plan = lookup(left, spark.range(2000).selectExpr("id as u", "id as m"), ["u"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


# --- clashing names ------------------------------------------------------------------------
def test_stages_give_back_columns_named_like_their_own(spark, documents, odd):
    names = [*CLASHING, "expected_grade", "tail", "keep", "grade", "digest", "kept", "n_bytes", "copy", "nth", "rows", "taken", "target", "text_key",
             "component_id", "root", "of", "none", "item", "level", "queue", "chunk"]
    docs = documents(odd).withColumns({c: F.lit(f"mine {c}") for c in names})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    kept = quality.graded(docs, quality.ratings_of(labels), keep=0.0).select("row.*")
    for out in (kept, simhash.one_of_each(docs), substrings.without_repeats(docs), mixing.mix_documents(docs)):
        assert out.columns == docs.columns
        got = rows_of(out)
        assert got and all(r[c] == f"mine {c}" for r in got for c in names)
    assert packing.pack(docs).count() and sharding.shard_table(docs).count() == len(odd)
    assert license_scan.license_report(docs).count() == len(odd) == minhash.edited_table(docs, classes=True).count()
    assert toxicity.toxicity(docs, labels).count() == len(odd) == simhash.near_duplicates(docs).count()


def test_vectors_with_clashing_columns(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)]
    names = ["k1", "k2", "dim", "vector", "ids", "visit", "visits", "block", "kind", "table", "bucket", "score", "rank", "query_id"]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ask = lambda df: sorted(map(tuple, ann.nearest(df, lambda v: v % 50 == 0).collect()))
    assert ask(plain.withColumns({c: F.lit("x") for c in names})) == ask(plain)


# --- nearest neighbours ----------------------------------------------------------------------
def test_exact_mode_finds_the_true_nearest(spark):
    from tests.llm.test_layout_operators import brute_nearest, vectors
    rng = np.random.default_rng(16)
    rows = [(i, [float(x) for x in rng.normal(size=12)], 0) for i in range(1500)]
    got = {}
    for r in sorted(rows_of(ann.nearest(vectors(spark, rows), lambda v: v % 50 == 0, exact=True)), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in near] for q, near in brute_nearest(rows).items()}


def test_index_rows_move_once_whatever_the_queries(spark):
    """The block join's input has one row per index row and table, however many queries there are."""
    rng = np.random.default_rng(17)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(800)], "vec_id long, embedding array<float>")
    seen = []
    met = ann._met

    def counted(left, right, most):
        seen.append(left.count())
        return met(left, right, most)

    ann._met = counted
    try:
        for step in (50, 2):
            ann.nearest(df, lambda v, step=step: v % step == 0).collect()
    finally:
        ann._met = met
    assert seen == [800 * ann.TABLES, 800] * 2


# --- toxicity ---------------------------------------------------------------------------------------
def test_messages_are_carried_across_runs(monkeypatch):
    """The marginals of long chains do not depend on where they are cut."""
    rng = np.random.default_rng(20)
    trans = np.array([[0.4, -1.3], [-0.7, 1.1]])
    model = toxicity.Model(rng.normal(size=(3, 1 << toxicity.BITS)), -0.3, trans, np.zeros(5), np.zeros(4), np.ones(4))
    counts = [300, 1, 64, 65, 128, 7, 200]
    text = np.repeat(np.arange(len(counts) + 1), [*counts, 0])
    features = rng.integers(0, 1 << toxicity.BITS, (len(text), 3))
    got = {}
    for run in (1, 7, 64, 400):
        monkeypatch.setattr(toxicity, "RUN", run)
        got[run] = toxicity.marginals(model, features, text, len(counts) + 1)
    for run in (1, 7, 64):
        assert np.allclose(got[run], got[400], atol=1e-9)
    odds = np.exp(toxicity.evidence(model.weights, model.bias, features[:300]))[None, :]
    whole, _ = toxicity.forward_backward(odds, np.array([300]), trans)
    assert np.allclose(got[64][:300], whole[0], atol=1e-9)


# --- quality ------------------------------------------------------------------------------------------
def test_ordinal_gradients_equal_differences():
    rng = np.random.default_rng(21)
    n, width = 30, 1 << quality.BITS
    col = rng.integers(0, 12, 150)
    grams = (np.sort(rng.integers(0, n, 150)), col, rng.normal(size=150))
    z, grades = rng.normal(size=(n, quality.SHAPES)), rng.integers(0, 4, n)
    w = np.zeros(width)
    w[:12] = rng.normal(size=12)
    params = [w, rng.normal(size=quality.SHAPES), np.array([-0.8, 0.1, -0.4])]
    _, grads = quality.slopes(*params, grams, z, grades)
    for k, x in enumerate(params):
        for i in range(min(len(x), 12)):
            old, values = x[i], []
            for e in (1e-5, -1e-5):
                x[i] = old + e
                values.append(quality.slopes(*params, grams, z, grades)[0])
            x[i] = old
            assert abs((values[0] - values[1]) / 2e-5 - grads[k][i]) < 1e-6


def test_fitting_lowers_the_loss_and_orders_the_grades():
    rng = np.random.default_rng(22)
    grades = rng.integers(0, 3, 240)
    texts = [(" ".join(rng.choice(["poor", "noise"] if g == 0 else ["fine", "words"] if g == 1 else ["good", "great"], 30))).encode() for g in grades]
    model = quality.fit(texts, grades)
    assert (np.diff(model.thresholds) > 0).all()
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    expected = quality.tails(model, offsets, np.frombuffer(b"".join(texts), dtype=np.uint8)).sum(axis=1)
    assert expected[grades == 0].max() < expected[grades == 1].min() and expected[grades == 1].max() < expected[grades == 2].min()


# --- license scan --------------------------------------------------------------------------------
def test_only_ascii_letters_are_lowered(documents):
    text = "This wor\u212a is licensed under a creative commons attribution 4 0 international license"
    got = rows_of(license_scan.license_report(documents([(1, text, "s"), (2, text.replace("\u212a", "K"), "s"), (3, "MIT L\u0130CENSE", "s")])))
    by = {r["doc_id"]: r for r in got}
    assert by[2]["labels"] == "cc-by" and by[2]["score"] == 1.0 and by[1]["score"] < 1.0 and by[3]["labels"] == ""


# --- packing ---------------------------------------------------------------------------------------
def test_a_share_of_nothing_is_packed_too(documents):
    rows = [(i, "some words here " * 20, "ab"[i % 2]) for i in range(200)]
    got = rows_of(packing.pack(documents(rows), shares={"a": 1.0, "b": 0.0}))
    tokens = {r["doc_id"]: r["doc_tokens"] for r in got}
    length = Counter()
    for r in got:
        length[r["doc_id"]] += r["length"]
    assert length == tokens and len(tokens) == 200


def test_longer_pieces_by_parameter(documents):
    rows = [(i, f"word{i % 31} " * 400, f"s{i % 12}") for i in range(240)]
    short, long = (rows_of(packing.pack(documents(rows), least=n)) for n in (16, 400))
    mean = lambda rs: np.mean([r["length"] for r in rs])
    assert mean(long) > 1.5 * mean(short)
    for rs in (short, long):
        assert sum(r["length"] for r in rs) == sum({r["doc_id"]: r["doc_tokens"] for r in rs}.values())


# --- long texts -------------------------------------------------------------------------------------
def test_anchors_of_a_long_text_in_slices(monkeypatch):
    rng = np.random.default_rng(18)
    for data in (rng.integers(97, 101, 5000).astype(np.uint8), np.full(3000, 97, dtype=np.uint8), np.tile(rng.integers(97, 123, 70), 60).astype(np.uint8)):
        at = np.array([0, len(data)])
        whole = [x.tolist() for x in substrings.anchors(data, at)]
        for size in (64, 257, 1000):
            monkeypatch.setattr(substrings, "SLICE", size)
            assert [x.tolist() for x in substrings.anchors(data, at)] == whole
        monkeypatch.undo()


def test_memory_of_a_long_texts_anchors():
    import tracemalloc
    data = np.random.default_rng(19).integers(97, 123, 20_000_000).astype(np.uint8)
    textbytes.powers(1 << 18)
    tracemalloc.start()
    counts, gaps, windows = substrings.anchors(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts[0] == len(gaps) == len(windows) and windows.astype(np.int64).sum() == len(data) - 49
    assert peak < 6 * len(data)


# --- what is left behind ------------------------------------------------------------------------------
def test_scope_removes_what_was_written_inside(spark, documents, odd):
    import os
    outer = written(spark.range(3).toDF("x"), "outer")
    base = os.path.dirname(outer.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0])
    before = set(os.listdir(base))
    with scope(spark):
        got = substrings.remove_repeats(documents(odd)).count()
        assert minhash.near_duplicate_classes(documents(odd)).count() == got == len(odd)
        assert len(os.listdir(base)) > len(before)
    assert set(os.listdir(base)) == before and outer.count() == 3


def test_shuffle_files_go_with_the_write(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    with tidy(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before


def test_pipeline_leaves_its_stages_only(spark, documents, tmp_path):
    import os
    import corpus_pipeline as cp
    rows = [(i, f"text number {i} of some words " * (i % 4 + 1), "ab"[i % 2]) for i in range(40)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    marker = written(spark.range(1).toDF("x"), "marker")
    base = os.path.dirname(marker.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0])
    before = set(os.listdir(base))
    assert cp.run(spark, str(tmp_path)).count() > 0
    left = {f.rsplit("-", 1)[0] for f in set(os.listdir(base)) - before}
    assert left == {f"stage-{i}" for i in range(5)}


def test_kept_bytes_are_hashed_alike(documents):
    docs = documents([(1, "a b c d e f", "s")])
    r = rows_of(minhash.edited_table(docs))[0]
    sig = minhash.signatures([b"a b c d e f"])[0]
    assert r["fingerprint"] == minhash.fingerprint(sig) and len(r["fingerprint"]) == minhash.PERMUTATIONS * minhash.BITS_KEPT // 4
    assert r["edited_sha256"] == hashlib.sha256(("a b c d e f"[:9] + "a ").encode()).hexdigest()
