"""License scan, fingerprints, SimHash, toxicity and quality against brute force and on odd input."""
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from blotter.llm import golay, license_scan, minhash, quality, simhash, toxicity

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- op1 -----------------------------------------------------------------------
def base_hits(text):
    words = re.findall(license_scan.WORD, (text or "").translate(LOWER))
    hits = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    return len(words), hits


def test_license_base_phrases(documents, odd):
    texts = ["MIT license mit LICENSE", "the Apache-License, general public license", "mit licenses", "license mit license " * 50,
             "GNU general\npublic\tlicense", *[t for _, t, _ in odd]]
    docs = documents([(i, t, "s") for i, t in enumerate(texts)], clashing=True)
    for r in rows_of(license_scan.license_report(docs)):
        n, hits = base_hits(texts[r["doc_id"]])
        starts = [i for i, _ in hits]
        assert (r["n_words"], r["n_base"]) == (n, len(hits))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits})) and 0 <= r["score"] <= 1


def test_license_notice_with_gaps(documents):
    notice = license_scan.NOTICES[4][0].split()
    edited = notice[:10] + ["really"] + notice[10:]  # an inserted word moves the rest to the next diagonal
    docs = documents([(0, "intro " + " ".join(edited) + " end", "s"), (1, " ".join(notice[:8]), "s"), (2, "of the software and to the terms", "s")])
    got = {r["doc_id"]: r for r in rows_of(license_scan.license_report(docs))}
    assert got[0]["labels"] == "mit" and got[0]["base_labels"] == "" and got[0]["score"] > 0.6
    assert got[1]["labels"] == "" and got[2]["labels"] == ""


def test_license_repeated_rows_and_empty(documents, odd):
    got = Counter(r["doc_id"] for r in rows_of(license_scan.license_report(documents(odd))))
    assert got == Counter(i for i, _, _ in odd)
    assert license_scan.license_report(documents([])).count() == 0


# --- op5 -----------------------------------------------------------------------
def shingle_set(text, k=5):
    w = text.encode().split()
    return {b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    texts = [base]
    for changed in (0, 3, 10, 40, 120):
        t = list(base)
        for i in rng.choice(300, changed, replace=False):
            t[i] = f"x{rng.integers(1 << 30)}"
        texts.append(t)
    sig = minhash.signatures([" ".join(t).encode() for t in texts])
    for t, s in zip(texts, sig):
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(t))
        got = minhash.likeness(sig[:1], s[None])[0]
        assert abs(got - len(a & b) / len(a | b)) < 0.17
    assert minhash.likeness(sig[:1], sig[1:2])[0] == 1.0


def test_edited_table_against_brute_force(spark, documents, odd):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    rows = [(i, t, s) for i, t, s in odd if i is not None and i != 4] + [(4, "short", "a")] + [(i, f"text {i} " * (i % 7), "s") for i in range(20, 60)]
    got = {r["doc_id"]: r for r in rows_of(minhash.edited_table(documents(rows, clashing=True)))}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    order = sorted((i, t or "") for i, t, _ in rows)
    assert sorted(got) == [i for i, _ in order]
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 4
        edited = t[:len(t) - cut] + nxt[:cut]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == minhash.fingerprint(minhash.signatures([edited.encode()])[0])
        assert r["fingerprint"] == minhash.fingerprint(minhash.signatures([t.encode()])[0])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_edited_table_small_and_repeated(documents, odd):
    assert minhash.edited_table(documents([])).count() == 0
    one = rows_of(minhash.edited_table(documents([(7, "a b c d", "s")])))
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert minhash.edited_table(documents(odd)).count() == len(odd)


def test_minhash_classes(documents):
    base = [f"w{i}" for i in range(200)]
    near, far = [*base[:199], "other"], [f"v{i}" for i in range(200)]
    docs = documents([(5, " ".join(base), "s"), (3, " ".join(near), "s"), (9, " ".join(base), "s"), (1, " ".join(far), "s"), (2, None, "s"), (4, "", "s")])
    got = dict(minhash.near_duplicate_classes(docs).collect())
    assert got == {5: 3, 3: 3, 9: 3, 1: 1, 2: 2, 4: 2}


def test_fingerprint_query_gives_classes(spark, documents, odd, tmp_path):
    from blotter.llm.queries import op5_fingerprint
    near = " ".join(f"w{i}" for i in range(100))
    rows = [*odd, (20, near, "s"), (21, near + " more", "s"), (21, "other words in a row of the same id", "s"), (22, near, "s")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = op5_fingerprint(spark, str(tmp_path))
    assert out.columns[-1] == "class_id" and "text_key" not in out.columns
    got = rows_of(out)
    plain = minhash.edited_table(documents(rows))
    key = lambda r: tuple(str(r[c]) for c in plain.columns)
    assert sorted(map(key, got)) == sorted(map(key, rows_of(plain)))
    want = minhash.near_duplicate_classes(documents(rows)).collect()
    assert sorted(map(str, ((r["doc_id"], r["class_id"]) for r in got))) == sorted(str(tuple(r)) for r in want)
    classes = {(r["doc_id"], r["n_chars"]): r["class_id"] for r in got}
    assert classes[20, len(near)] == classes[21, len(near) + 5] == classes[22, len(near)] == 20 and classes[21, 35] == 21


def test_minhash_classes_against_brute_force(documents):
    """Chains and stars of near copies: a band's least node links few of its members, others link to one another."""
    rng = np.random.default_rng(4)
    texts = []
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(120)]
        for step in range(14):
            texts.append(" ".join(words))
            at = rng.integers(0, 120, 1 if family % 2 else 3)
            words = list(words)
            for a in at:
                words[a] = f"f{family}x{step}_{a}"
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    root[i] = root[j] = min(root[i], root[j])
    got = dict(minhash.near_duplicate_classes(documents([(i, t, "s") for i, t in enumerate(texts)])).collect())
    assert got == dict(enumerate(root)) and 6 < len(set(root)) < len(texts)


# --- op10 ----------------------------------------------------------------------
def brute_fingerprint(text):
    w = (text or "").translate(LOWER).encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_golay_is_perfect():
    words = np.arange(0, 1 << 23, 1013)
    keys = golay.keys(words)
    assert (keys[:, 0] >= 0).all() and set((keys >= 0).sum(axis=1)) <= {1, 6}
    flipped = golay.keys(words ^ (1 << 7))
    assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(keys, flipped))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.lists(st.integers(0, 63), max_size=3))
def test_golay_keys_lose_no_link(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    left = simhash.join_keys(np.array([fp], dtype=np.uint64), False)[0]
    right = simhash.join_keys(np.array([other], dtype=np.uint64), True)[0]
    assert set(left.tolist()) & set(right.tolist())


def test_simhash_components_against_brute_force(spark, documents, odd):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, t, s) for i, t, s in odd if i is not None and i != 4]
    for i in range(100, 160):
        text = list(words)
        for k in rng.choice(400, i % 5, replace=False):
            text[k] = f"z{k}"
        rows.append((i, " ".join(text), "s"))
    got = {r["doc_id"]: r for r in rows_of(simhash.near_duplicates(documents(rows, clashing=True)))}
    order = sorted((i, t) for i, t, _ in rows)
    fps = [brute_fingerprint(t) for _, t in order]
    for (i, _), fp, root in zip(order, fps, brute_components(fps)):
        assert got[i]["fp"] % (1 << 64) == fp and got[i]["component_id"] == order[root][0]


def test_fingerprint_keys_are_not_broadcast(spark):
    from blotter.llm.common import written
    rows = [((1 << k) - 1,) for k in range(20)] + [((1 << 40) + 5,), ((1 << 40) + 1,)]
    pairs = simhash.links(written(spark.createDataFrame(rows, "fp long"), "few-fingerprints"))
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    fps = sorted(fp for fp, in rows)
    want = {(u, v) for i, u in enumerate(fps) for v in fps[i + 1:] if (u ^ v).bit_count() <= 3}
    assert {tuple(r) for r in pairs.collect()} == want


def test_the_pipelines_stage_does_not_broadcast_keys(spark, documents, odd, monkeypatch):
    import corpus_pipeline
    plans, found = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or found(edges))
    assert corpus_pipeline.simhash(spark, documents(odd), "").count() > 0
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_one_of_each(documents, odd):
    kept = rows_of(simhash.one_of_each(documents(odd)))
    ids = sorted(r["doc_id"] for r in kept)
    assert 3 in ids and 4 not in ids and None not in ids and ids.count(0) == 1 and 1 not in ids
    assert simhash.one_of_each(documents([])).count() == 0 and simhash.near_duplicates(documents([])).count() == 0


# --- op6, op8 ------------------------------------------------------------------
def labelled(spark, documents, n=600):
    rng = np.random.default_rng(1)
    vocabulary = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(vocabulary, 60).tolist()
        toxic, low = int(i % 6 == 0), int(i % 5 == 0)
        if toxic:
            for k in rng.choice(60, 5, replace=False):
                words[k] = ["idiot", "scum", "moron"][k % 3]
        text = (" | " if low else " ").join(words)
        rows.append((i, text, "s"))
        labels.append((i, 1 - low, toxic))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_held_out(spark, documents):
    docs, labels, truth = labelled(spark, documents)
    got = {r["doc_id"]: r for r in rows_of(toxicity.toxicity(docs, labels))}
    for i, _, toxic in truth:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    right = [got[i]["predicted"] == toxic for i, _, toxic in truth if got[i]["held_out"]]
    assert np.mean(right) > 0.98
    text = docs.filter("doc_id = 0").first().text
    spans = {text.encode()[s["start"]:s["end"]].decode() for s in got[0]["spans"]}
    assert spans and all(set(s.split()) <= {"idiot", "scum", "moron"} for s in spans)


def test_toxicity_never_sees_held_out_labels(spark, documents):
    docs, labels, _ = labelled(spark, documents, 200)
    from pyspark.sql import functions as F
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r["doc_id"]: r["score"] for r in rows_of(toxicity.toxicity(docs, labels))}
    assert a == {r["doc_id"]: r["score"] for r in rows_of(toxicity.toxicity(docs, flipped))}


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    odds, trans = np.exp(rng.normal(size=(1, 5))), rng.normal(size=(2, 2))
    m, pairs = toxicity.forward_backward(odds, np.array([5]), trans)
    total, states, moves = 0.0, np.zeros(5), np.zeros((2, 2))
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        p = np.prod([odds[0, k] ** y[k] for k in range(5)]) * np.exp(sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += p
        states += p * np.array(y)
        for a, b in zip(y, y[1:]):
            moves[a, b] += p
    assert np.allclose(m[0], states / total) and np.allclose(pairs, moves / total)


def test_quality_grades(spark, documents):
    docs, labels, truth = labelled(spark, documents)
    got = {r["row"]["doc_id"]: r for r in rows_of(quality.graded(docs, quality.ratings_of(labels)))}
    assert np.mean([got[i]["keep"] == bool(q) for i, q, _ in truth]) > 0.99
    assert all(0 <= r["tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values())


def test_classifiers_on_odd_input(spark, documents, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(None, 1, 1), (3, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        docs = documents(odd, clashing=True)
        assert {r["score"] for r in rows_of(toxicity.toxicity(docs, labels))} == {0.0}
        clash = documents(odd, clashing=True).selectExpr("*", "'mine' as keep", "'mine' as tail", "'mine' as expected_grade")
        out = rows_of(quality.graded(clash, quality.ratings_of(labels)))
        assert all(r["row"][c] == "mine" for r in out for c in ("keep", "tail", "expected_grade"))
        assert len(out) == len(odd) and all(r["keep"] for r in out)
    docs, labels, _ = labelled(spark, documents, 200)
    assert toxicity.toxicity(documents(odd), labels).count() == len(odd)
    assert toxicity.toxicity(documents([]), labels).count() == 0 and quality.graded(documents([]), quality.ratings_of(labels)).count() == 0
    with pytest.raises(Exception):
        toxicity.toxicity(docs.drop("text"), labels).count()


# --- SQL ----------------------------------------------------------------------
@pytest.mark.parametrize("name", ["op1_license_scan", "op7_suffix_dedup", "op11_line_dedup", "op12_prefix_trie", "op13_lexical_search"])
def test_query_matches_its_sql(spark, sf, name):
    import duckdb

    from blotter.llm.oracle import ORACLE_SQL
    from blotter.llm.queries import QUERIES
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    res = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in res.description]
    want = sorted(map(repr, res.fetchall()))
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want
