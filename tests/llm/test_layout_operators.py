"""Mixing, packing, nearest neighbours, repeated passages, sharding and the pipeline against brute force and on odd input."""
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from blotter.llm import ann, mixing, packing, sharding, substrings, suffixes
from blotter.llm.common import written


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- op2 -----------------------------------------------------------------------
def water_filled(sizes):
    """Targets by repeated sharing of the excess."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_ = [s for s in order if s not in capped]
        if not open_:
            return capped
        want = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if want[s] > 3 * sizes[s]]
        if not over:
            return capped | want
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mix_targets_and_rounding(documents):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["a", "b", "c", "d", None][min(4, int(rng.integers(0, 12)) // 2)]) for i in range(3000)]
    docs = documents(rows, clashing=True)
    got = rows_of(mixing.mix_table(docs))
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    sizes, taken, most = Counter(), Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
        most[s] = max(most[s], len(t.split()))
    target = water_filled(sizes)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    again = rows_of(mixing.mix_table(docs.repartition(5)))
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in got}


def test_mix_keeps_probabilities(documents):
    """Over many small sources a document is taken about as often as its rate says."""
    docs = documents([(s * 10 + k, " ".join(["w"] * (k + 1)), f"s{s:03}") for s in range(240) for k in range(6)])
    off = defaultdict(list)
    for r in rows_of(mixing.rounded(written(mixing.sizes(docs), "t"), chunk=4)):
        off[r["size"]].append(r["copies"] - r["target"] / r["source_size"])
    assert all(abs(np.mean(v)) < 0.12 for v in off.values())


def test_mix_documents_odd(documents, odd):
    docs = documents(odd, clashing=True)
    table = rows_of(mixing.mix_table(documents(odd)))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    got, want = Counter(r["doc_id"] for r in rows_of(out)), Counter()
    for r in table:
        want[r["doc_id"]] += r["copies"]
    assert got == +want
    assert mixing.mix_table(documents([])).count() == 0 and mixing.mix_documents(documents([])).count() == 0


# --- op3 -----------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.vocabulary_path())
    t.encode_special_tokens = True
    return t


def check_pieces(got, texts, library, window=2048):
    ids = [np.array([*x.ids, 1], dtype="<u4") for x in library.encode_batch(texts, add_special_tokens=False)]
    want = Counter(x.tobytes() for x in ids)
    docs = defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
    assert sum(r["length"] for r in got) == sum(len(x) for x in ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == window or (at < window and at & (at - 1) == 0)
    return want, docs, ids


def test_pack_round_trip(documents, odd, library):
    rows = [(i, t, s) for i, t, s in odd if i is not None and i != 4] + [(i, f"It's document {i}.  \n\n" * (i % 90), "abc"[i % 3]) for i in range(100, 400)]
    got = rows_of(packing.pack(documents(rows, clashing=True)))
    _, docs, ids = check_pieces(got, [t or "" for _, t, _ in rows], library)
    for (i, _, _), x in zip(rows, ids):
        at = 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            part = x[r["start"]:r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(x)


def test_pack_repeated_null_and_empty(documents, odd, library):
    got = rows_of(packing.pack(documents(odd)))
    check_pieces(got, [t or "" for _, t, _ in odd], library)
    assert packing.pack(documents([])).count() == 0


def test_pack_follows_the_mixture(documents):
    rows = [(i, f"some words of document {i} " * 20, "a" if i % 4 else "b") for i in range(800)]
    source = {i: s for i, _, s in rows}
    total, share = Counter(), defaultdict(Counter)
    for r in rows_of(packing.pack(documents(rows))):
        total[source[r["doc_id"]]] += r["length"]
        share[r["sequence_id"] // 4][source[r["doc_id"]]] += r["length"]
    a = total["a"] / sum(total.values())
    for c in share.values():
        full = sum(c.values()) == 4 * 2048  # the last sequences are shorter
        assert not full or abs(c["a"] / sum(c.values()) - a) < 0.1


def test_every_window_has_the_mixture(documents, library):
    """Documents longer than a window and a source of a few hundredths: each full window holds its share of each source."""
    rows = [(i, f"some words of document {i} " * (1500 if i % 40 == 0 else 60), "a") for i in range(120)]
    rows += [(1000 + i, f"other text {i} " * 300, "b") for i in range(12)] + [(2000 + i, f"tiny {i}", "c") for i in range(20)]
    source, share, total = {i: s for i, _, s in rows}, defaultdict(Counter), Counter()
    got = rows_of(packing.pack(documents(rows)))
    check_pieces(got, [t for _, t, _ in rows], library)
    for r in got:
        share[r["sequence_id"]][source[r["doc_id"]]] += r["length"]
        total[source[r["doc_id"]]] += r["length"]
    full = [c for c in share.values() if sum(c.values()) == 2048]
    assert len(full) > 10
    for c in full:
        for s in "abc":
            assert abs(c[s] - 2048 * total[s] / sum(total.values())) <= packing.LEAST + 3


def test_pieces_of_the_encoder(library):
    import random

    from blotter.llm.bpe import Encoder
    coder = Encoder(packing.vocabulary_path())
    rng = random.Random(1)
    parts = ["a", "s", "re", "ll", "'", "'s", "'ve", " ", "  ", "\n", "\t", "12", "é", "ß", ".", "!?", "—", "“", "½", "\x00", "\x85", " ", "中", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    assert [x.tolist() for x in coder.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


# --- op4 -----------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_nearest(rows, k=5):
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in good.items():
        if q % 50 == 0:
            near = [(-float(x @ y) / float(np.sqrt(x @ x) * np.sqrt(y @ y)), i) for i, y in good.items() if i != q and len(y) == len(x)]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def test_nearest_recall(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(10, 32))
    rows = [(i, [float(x) for x in centre[i % 10] * 0.5 + rng.normal(size=32)], 0) for i in range(3000)]
    got = defaultdict(dict)
    for r in rows_of(ann.nearest(vectors(spark, rows), lambda v: v % 50 == 0)):
        got[r["query_id"]][r["vec_id"]] = r["score"]
    want = brute_nearest(rows)
    hits = sum(i in got[q] for q, near in want.items() for i, _ in near)
    assert hits >= 0.9 * sum(map(len, want.values())) and all(len(got[q]) == 5 for q in want)


def test_nearest_odd_vectors(spark):
    hot = [1.0, 2.0, 3.0]
    rows = [(i, hot, 0) for i in range(0, 120, 3)] + [(1, None, 0), (2, [], 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 2.0], 0), (7, [float("nan"), 1.0, 1.0], 0),
            (8, [float("inf"), 1.0, 1.0], 0), (None, hot, 0), (50, [3.0, 1.0, 1.0], 0), (100, [1.0, 1.0], 0), (10, [-1.0, 0.0, 0.0], 0), (0, hot, 0)]
    got = defaultdict(list)
    for r in sorted(rows_of(ann.nearest(vectors(spark, rows), lambda v: v % 50 == 0)), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_nearest(rows)
    assert want[100] == [] and 100 not in got
    for q in (0, 50):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    few = rows_of(ann.nearest(vectors(spark, rows[-3:] + [(11, [0.0, 1.0, 0.0], 0)]), lambda v: v % 50 == 0))
    assert Counter(r["query_id"] for r in few) == {0: 2}
    assert ann.nearest(vectors(spark, []), lambda v: v % 50 == 0).count() == 0


# --- op7 -----------------------------------------------------------------------
def brute_cut(rows, window=50):
    first, out = {}, {}
    key = lambda i: float("inf") if i is None else i
    for i, t, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            w = b[p:p + window]
            first[w] = min(first.get(w, key(i)), key(i))
    for n, (i, t, _) in enumerate(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - window + 1):
            if first[b[p:p + window]] < key(i):
                gone[p:p + window] = True
        out[n] = (i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (len(b) > 0 and gone[0])), np.frombuffer(b, dtype=np.uint8)[~gone].tobytes())
    return out


def passages():
    rng = np.random.default_rng(8)
    alphabet = np.array(list("abcdefghij éß\n"))
    make = lambda n: "".join(rng.choice(alphabet, n))
    shared, rows = [make(int(rng.integers(30, 140))) for _ in range(6)], []
    for i in rng.permutation(60):
        t = make(int(rng.integers(0, 80)))
        for _ in range(int(rng.integers(0, 4))):
            t += shared[int(rng.integers(0, 6))] + make(int(rng.integers(0, 30)))
        rows.append((int(i), t, "s"))
    return [*rows, (70, "abab" * 60, "s"), (71, "x" + "abab" * 50, "s"), (72, rows[0][1], "s"), (None, shared[0] * 2, "s")]


def test_repeats_against_brute_force(documents, odd, monkeypatch):
    monkeypatch.setattr(substrings, "SORT", 3000)
    for rows in (passages(), odd):
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in rows_of(substrings.remove_repeats(documents(rows, clashing=True))))
        assert got == Counter((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute_cut(rows).values())
    assert substrings.remove_repeats(documents([])).count() == 0


def test_one_passage_in_many_contexts(documents, monkeypatch, tmp_path):
    """Its edges have one anchor and another segment in every document: no array and no group holds them all."""
    rng = np.random.default_rng(12)
    make = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    passage, rows = make(90), []
    for i in range(600):
        before, after = make(40), make(40)
        rows.append((i, before + passage + after, "s"))
    for i in range(600, 660):  # the passage with some of an earlier document's surroundings: windows over its edges repeat
        old = rows[i - 600][1]
        rows.append((i, make(9) + old[30 - i % 20:140 + i % 20] + make(9), "s"))
    whole, answers, most = substrings.equal_windows, substrings._answers, 3000

    def bounded(lens, data, least, window=50):
        assert lens.sum() <= most
        return whole(lens, data, least, window)

    def measured(window, at=str(tmp_path)):
        answer = answers(window)

        def one(group):
            size = sum(map(len, group.column("data").to_pylist()))
            with open(f"{at}/{group.column('shard')[0]}", "w") as f:
                f.write(str(size))
            return answer(group)
        return one

    monkeypatch.setattr(substrings, "SORT", most)
    monkeypatch.setattr(substrings, "equal_windows", bounded)
    monkeypatch.setattr(substrings, "_answers", measured)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in rows_of(substrings.remove_repeats(documents(rows))))
    assert got == Counter((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute_cut(rows).values())
    groups = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert len(groups) == 8 and max(groups) <= 1.25 * np.mean(groups)


def test_without_repeats(documents, odd):
    docs = documents(odd, clashing=True)
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    want = Counter((i, None if t is None else x[4].decode("utf-8", "ignore")) for (i, t, _), x in zip(odd, brute_cut(odd).values()))
    assert Counter((r["doc_id"], r["text"]) for r in rows_of(out)) == want


def test_suffix_arrays():
    rng = np.random.default_rng(9)
    for trial in range(150):
        s = np.append(rng.integers(1, 2 + rng.integers(1, 5), rng.integers(1, 80)), 0)
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


# --- op9 -----------------------------------------------------------------------
def check_shards(got, rows, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    load = np.zeros(shards)
    for r in got:
        load[r["shard"]] += r["size"]
    return load


def test_shards_are_even(documents, odd):
    rng = np.random.default_rng(10)
    rows = [(i, "copied text " * 4 if i % 3 == 0 else "y" * int(rng.integers(0, 90)) + str(i), "s") for i in range(6000)]
    load = check_shards(rows_of(sharding.shard_table(documents(rows, clashing=True))), rows, 16)
    assert abs(load / load.mean() - 1).max() < 0.02  # a group with a third of the rows is cut, at most at each splitter
    check_shards(rows_of(sharding.shard_table(documents(odd))), odd, 16)
    assert sharding.shard_table(documents([])).count() == 0


def test_small_groups_stay_whole(documents):
    rows = [(i, f"text {i // 2} " * 5, "s") for i in range(4000)]
    got = rows_of(sharding.shard_table(documents(rows)))
    of = defaultdict(set)
    for r in got:
        of[rows[r["doc_id"]][1]].add(r["shard"])
    assert all(len(v) == 1 for v in of.values())


def test_write_shards(spark, documents, tmp_path):
    rows = [(i, f"text {i} " * (i % 9), "s") for i in range(300)]
    sharding.write_shards(documents(rows), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("shard").distinct().count() == 4


# --- pipeline ------------------------------------------------------------------
def test_pipeline_stages(spark, sf, library):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    low = {r[0] for r in labels.filter("quality = 0").select("doc_id").collect()}
    clean = {r[0] for r in labels.filter("quality > 0").select("doc_id").collect()}
    for name, stage in cp.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), "t")
        if name != "packing":
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in before.schema]
        if name == "quality classifier":
            gone = {r[0] for r in before.select("doc_id").subtract(docs.select("doc_id")).collect()}
            assert gone and len(low - gone) <= 0.1 * len(low) + 1
            assert clean and len(clean & gone) <= 0.02 * len(clean) + 1
        elif name == "SimHash near-dedup":
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            from tests.llm.test_text_operators import brute_components, brute_fingerprint
            roots = brute_components([brute_fingerprint(t) for _, t in rows])
            assert sorted(r.doc_id for r in docs.collect()) == sorted({rows[k][0] for k in roots})
        elif name == "suffix-array dedup":
            rows = [(r.doc_id, r.text, "") for r in before.collect()]
            want = {x[0]: x[4].decode("utf-8", "ignore") for x in brute_cut(rows).values()}
            assert {r.doc_id: r.text for r in docs.collect()} == want
        elif name == "mixing sources":
            assert set(docs.select("doc_id").distinct().toPandas().doc_id) <= set(before.toPandas().doc_id)
            table = rows_of(mixing.rounded(written(mixing.sizes(before), "t")))
            got = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
            assert got == +Counter({r["doc_id"]: r["copies"] for r in table}) and len(table) == before.count()
            taken, most, target = Counter(), Counter(), {}
            for r in table:
                taken[r["source"]] += got[r["doc_id"]] * r["size"]
                most[r["source"]] = max(most[r["source"]], r["size"])
                target[r["source"]] = r["target"]
            assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6 for s in target)
        else:
            got = rows_of(docs)
            assert sum(r["length"] for r in got if r["start"] == 0) > 0 and len({r["doc_id"] for r in got}) == before.select("doc_id").distinct().count()
            texts = before.select("doc_id", "text").collect()
            check_pieces(got, [r.text or "" for r in texts], library)
            ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in set(texts)}
            times, copies = Counter(), Counter(r.doc_id for r in texts)
            for r in got:  # each token as often as its document has rows
                part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
                assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and len(part) == r["length"]
                times.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
            assert times == Counter({(i, k): copies[i] for i, x in ids.items() for k in range(len(x))})


def test_pipeline_on_empty_and_odd_documents(spark, documents, odd, tmp_path):
    import corpus_pipeline as cp
    labels = "doc_id long, quality int, toxic int"
    for n, rows in enumerate(([], odd)):
        d = str(tmp_path / str(n))
        documents(rows).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{d}/labels.parquet")
        out = cp.run(spark, d)
        assert (out.count() > 0) == bool(rows)
