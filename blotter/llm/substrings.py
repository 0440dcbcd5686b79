"""Removal of repeated passages: suffix arrays of shards, by induced sorting, over everything that may repeat.

A byte is removed if it is covered by a WINDOW-byte string that also starts in
a document with a smaller id.  Texts move at most once; what moves otherwise
are anchors, short segments and answers.

1. Documents are packed into rows of about PACK bytes, written as a bucketed
   table: later steps join their small answers to it without moving texts.
   Whole copies (equal digests) of a document with a smaller id are answered
   at once and take no further part.
2. Each window has an anchor, the GRAM-byte string in it with the least hash.
   A window that occurs twice has the same anchor in both places, so a window
   can only repeat if its anchor does.  The anchors' hashes go to shards, once
   per pack, and the packs hear which of theirs occur elsewhere.
3. The windows of a repeated anchor stand next to one another: they are one
   segment of less than two windows.  Different segments go to the anchor's
   shard, each once per pack, with the smallest id that holds it.
   The packs also tell how many different segments each anchor has: where they
   may be more than SORT bytes together (the edge of a frequent passage has
   another segment in each surroundings), the anchor's windows go singly, by
   their contents, which equal windows share.  Each is then one entry per pack.
4. A shard joins its different segments to one string, sorts its suffixes by
   induced sorting, and gets the places where neighbours in the array share
   WINDOW bytes in permuted order.  Windows between such neighbours are equal;
   each gets the smallest id of its equals.
5. The packs get the answers for their segments and cut their texts.

An anchor, segment or copy that a third of all documents share is one entry
per pack before anything is shuffled.

Defined cases: a null text has no bytes; texts shorter than a window lose
nothing; rows with equal ids don't remove from one another (no id is smaller);
a null id counts as larger than any other, and as equal to itself; empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import boxed, remove, text_of, written
from blotter.session import shared_dir

WINDOW, GRAM = 50, 16
PACK = 4_000_000
SORT = 1_000_000     # bytes of one suffix array
SLICE = 1 << 17      # bytes of anchors found at a time
SHARD = 4_000_000    # bytes of text for each shard: what one group holds does not grow with the input
NO_ID = np.int64((1 << 63) - 1)
U64 = np.uint64


# --- anchors -----------------------------------------------------------------
def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors per text, gap from the anchor before, windows of each anchor) of concatenated texts.

    A single text of more than SLICE bytes is taken in slices that overlap by a window less one byte, so that each window is in one.
    """
    if len(offsets) == 2 and len(data) > 2 * SLICE:
        each = [_places(data[a:a + SLICE + window - 1], np.array([0, len(data[a:a + SLICE + window - 1])]), window) for a in range(0, len(data) - window + 1, SLICE)]
        place = np.concatenate([p + k * SLICE for k, (p, _, _) in enumerate(each)])
        windows = np.concatenate([w for _, _, w in each])
        new = np.concatenate(([True], place[1:] != place[:-1]))      # an anchor's windows may go on in the next slice
        windows = np.add.reduceat(windows, np.flatnonzero(new))
        place, text = place[new], np.zeros(int(new.sum()), dtype=np.int64)
    else:
        place, text, windows = _places(data, offsets, window)
    counts = np.bincount(text, minlength=len(offsets) - 1).astype(np.int32)
    if not len(place):
        return counts, np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint8)
    new = np.concatenate(([True], text[1:] != text[:-1]))
    gap = np.where(new, place - offsets[text], np.diff(place, prepend=0))
    return counts, gap.astype(np.uint8), windows.astype(np.uint8)


def _places(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, windows) of the anchors."""
    from blotter.llm.textbytes import range_hash, running
    n, span = len(data), window - GRAM + 1
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none
    at = np.arange(n - GRAM + 1)
    least = (range_hash(running(data), at, at + GRAM) & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    place = (least & U64(0xFFFFFFFF)).astype(np.int64)       # of the anchor of the window that starts here
    text = np.searchsorted(offsets, np.arange(len(place)), side="right") - 1
    whole = np.arange(len(place)) + window <= offsets[text + 1]
    place, text = place[whole], text[whole]
    if not len(place):
        return none, none, none
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    return place[first], text[first], np.diff(np.append(first, len(place)))


def _packs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    from blotter.llm.textbytes import spans, text_bytes
    number = TaskContext.get().partitionId() << 32
    ids: list[np.ndarray] = []
    raw: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal ids, raw, held, number
        lens = np.array([len(x) for x in raw], dtype=np.int64)
        offsets, data = np.concatenate(([0], np.cumsum(lens))), np.concatenate(raw)
        found = [anchors(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], window) for i, j in spans(offsets, SLICE)]
        parts = [np.concatenate([f[k] for f in found]) for k in range(3)]
        digests = b"".join(hashlib.sha256(x).digest()[:16] for x in raw)
        cells = [np.array(ids, dtype=np.int64).tobytes(), lens.tobytes(), digests, *(p.tobytes() for p in parts), data.tobytes()]
        out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(data)], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)],
                                         ["pack", "bytes", "ids", "lens", "digests", "counts", "gaps", "windows", "data"])
        number, ids, raw, held = number + 1, [], [], 0
        return out

    for batch in batches:
        offsets, data = text_bytes(batch.column(1))
        keys = batch.column(0).cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            ids.append(keys[i])
            raw.append(data[a:b].copy() if held + b - a < PACK else data[a:b])
            held += b - a
            if held >= PACK or len(ids) >= 1 << 16:
                yield flush()
    if ids:
        yield flush()


class Pack:
    """One packed row, and what can be told of it without its neighbours."""

    def __init__(self, row: dict):
        self.number = row["pack"]
        self.ids, self.lens = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["lens"], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lens)))
        self.data = np.frombuffer(row["data"], dtype=np.uint8)
        counts = np.frombuffer(row["counts"], dtype=np.int32)
        gaps, windows = np.frombuffer(row["gaps"], dtype=np.uint8).astype(np.int64), np.frombuffer(row["windows"], dtype=np.uint8).astype(np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        upto = np.concatenate(([0], np.cumsum(counts)))[:-1]
        within = lambda x: np.cumsum(x) - np.repeat((np.cumsum(x) - x)[upto[counts > 0]], counts[counts > 0])
        copied = np.zeros(len(counts), dtype=bool)
        copied[np.array(row.get("copies") or [], dtype=np.int64)] = True
        self.copied = copied
        own = ~copied[doc]
        self.doc = doc[own]
        self.at = (self.offsets[doc] + within(gaps))[own] if len(doc) else doc
        self.first = (self.offsets[doc] + within(windows) - windows)[own] if len(doc) else doc  # first window's start
        self.windows = windows[own]

    def sums(self) -> np.ndarray:
        from blotter.llm.textbytes import running
        return running(self.data)

    def hashes(self, sums: np.ndarray) -> np.ndarray:
        """Of the anchors; the lowest bit is free."""
        from blotter.llm.textbytes import range_hash
        return range_hash(sums, self.at, self.at + GRAM) & U64(0xFFFFFFFFFFFFFFFE)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> U64(33)) % U64(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of sorted shard numbers."""
    if len(shard):
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        yield from zip(shard[first].tolist(), first.tolist(), [*first[1:].tolist(), len(shard)])


def _told(shards: int, window: int):
    """Packs -> (shard, pack, hashes, many, more): each different anchor once, its lowest bit set if two ids of the pack
    hold it; the anchors of more than one different segment, and how many more."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pack = Pack(row)
            sums = pack.sums()
            h = pack.hashes(sums)
            many, more = _different(pack, sums, h, window)
            order = np.lexsort((pack.ids[pack.doc], h))
            h, who = h[order], pack.ids[pack.doc][order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
            last = np.append(first[1:], len(h))[:len(first)] - 1  # a pack of short texts has no anchors
            mark = h[first] | (who[first] != who[last]).astype(U64)
            shard = _shard(mark, shards)
            order = np.argsort(shard, kind="stable")
            mark, shard = mark[order], shard[order]
            cuts = list(_by_shard(shard))
            to = _shard(many, shards)
            order = np.argsort(to, kind="stable")
            many, more, to = many[order], more[order], to[order]
            at = [slice(*np.searchsorted(to, [c[0], c[0] + 1])) for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int64()), pa.array([pack.number] * len(cuts), pa.int64()),
                                              pa.array([mark[a:b].tobytes() for _, a, b in cuts], pa.binary()),
                                              *(pa.array([x[k].tobytes() for k in at], pa.binary()) for x in (many, more))],
                                             ["shard", "pack", "hashes", "many", "more"])
    return make


def _different(pack: Pack, sums: np.ndarray, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors of a pack that have more than one different segment, how many more)."""
    from blotter.llm.textbytes import range_hash
    ordered = np.sort(h)
    again = np.flatnonzero(_in(h, np.unique(ordered[1:][ordered[1:] == ordered[:-1]])))
    h, content = h[again], range_hash(sums, pack.first[again], pack.first[again] + pack.windows[again] + window - 1)
    order = np.lexsort((content, h))
    h, content = h[order], content[order]
    many, more = np.unique(h[1:][(h[1:] == h[:-1]) & (content[1:] != content[:-1])], return_counts=True)
    return many, more.astype(np.int32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _repeated(window: int):
    """A shard's anchors -> (pack, shard, hashes): those of each pack that more than one id holds, the lowest bit set if
    the anchor's different segments may be more than SORT bytes."""
    def repeated(group: pa.Table) -> pa.Table:
        packs, blobs = group.column("pack").to_pylist(), group.column("hashes").to_pylist()
        all_ = np.concatenate([np.frombuffer(b, dtype=U64) for b in blobs])
        bare = np.sort(all_ & U64(0xFFFFFFFFFFFFFFFE))
        again = bare[1:][bare[1:] == bare[:-1]]
        twice = np.union1d(again, all_[(all_ & U64(1)) == 1] & U64(0xFFFFFFFFFFFFFFFE))
        del all_, bare
        # different segments beyond the first: one for each further pack, and what the packs tell
        many, more = (np.concatenate([np.frombuffer(b, dtype=kind) for b in group.column(k).to_pylist()]) for k, kind in (("many", U64), ("more", np.int32)))
        which, counts = np.unique(again, return_counts=True)
        which, place = np.unique(np.concatenate((which, many)), return_inverse=True)
        segments = 1 + np.bincount(place, np.concatenate((counts, more)), len(which))
        heavy = which[segments * (2 * window - GRAM) > SORT]
        out = []
        for b in blobs:
            h = np.frombuffer(b, dtype=U64) & U64(0xFFFFFFFFFFFFFFFE)
            h = h[_in(h, twice)]
            out.append((h | _in(h, heavy).astype(U64)).tobytes())
        shard = group.column("shard")[0].as_py()
        return pa.table([pa.array(packs, pa.int64()), pa.array([shard] * len(packs), pa.int64()), pa.array(out, pa.binary())], names=["pack", "shard", "hashes"])
    return repeated


def _in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(x), dtype=bool)
    place = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[place] == x


class Segments:
    """The different segments of a pack's repeated anchors, in the order of (shard, anchor, content).

    A heavy anchor's windows are a segment each, and each content is an anchor of its own.
    """

    def __init__(self, row: dict, shards: int, window: int):
        from blotter.llm.textbytes import mix, range_hash
        pack = self.pack = Pack(row)
        sums = pack.sums()
        h = pack.hashes(sums)
        told = np.sort(np.concatenate([np.zeros(0, dtype=U64), *(np.frombuffer(x["hashes"], dtype=U64) for x in row["repeated"] or [])]))
        use = _in(h, told & U64(0xFFFFFFFFFFFFFFFE))
        h, self.doc, self.first, self.windows = h[use], pack.doc[use], pack.first[use], pack.windows[use]
        heavy = _in(h | U64(1), told)
        if heavy.any():
            times = np.where(heavy, self.windows, 1)
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            h, heavy, self.doc, self.first, self.windows = (np.repeat(x, times) for x in (h, heavy, self.doc, self.first, self.windows))
            self.first = self.first + nth
            self.windows = np.where(heavy, 1, self.windows)
            at = self.first[heavy]
            h[heavy] = mix(h[heavy] ^ range_hash(sums, at, at + window))
        self.end = self.first + self.windows + window - 1
        content = range_hash(sums, self.first, self.end)
        shard = _shard(h, shards)
        order = np.lexsort((pack.ids[self.doc], content, h, shard))
        h, content, shard = h[order], content[order], shard[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (content[1:] != content[:-1]))) if len(h) else np.zeros(0, dtype=bool)
        self.which = np.empty(len(h), dtype=np.int64)  # segment of each occurrence
        self.which[order] = np.cumsum(new) - 1
        pick = order[new]
        self.shard, self.hash = shard[new], h[new]
        self.least = pack.ids[self.doc[pick]]          # smallest id, by the sort
        self.from_, self.to = self.first[pick], self.end[pick]


def _sent(shards: int, window: int):
    """Packs -> (shard, pack, hashes, least, lens, data) of their different segments."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Segments(row, shards, window)
            lens = s.to - s.from_
            upto = np.concatenate(([0], np.cumsum(lens)))
            cuts = list(_by_shard(s.shard))
            cells = [[x[a:b].tobytes() for _, a, b in cuts] for x in (s.hash, s.least, lens.astype(np.int16))]
            cells.append([s.pack.data[np.repeat(s.from_[a:b] - upto[a:b], lens[a:b]) + np.arange(upto[a], upto[b])].tobytes() for _, a, b in cuts])
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int64()), pa.array([s.pack.number] * len(cuts), pa.int64()),
                                              *(pa.array(c, pa.binary()) for c in cells)], ["shard", "pack", "hashes", "least", "lens", "data"])
    return make


def equal_windows(lens: np.ndarray, data: np.ndarray, least: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For every window of concatenated segments the smallest id of a segment that holds an equal one."""
    from blotter.llm.suffixes import shares_prefix, suffix_array
    n = len(lens)
    upto = np.concatenate(([0], np.cumsum(lens)))
    raw = np.full(upto[-1] + n, 0xFF, dtype=np.uint8)        # 0xFF ends a segment: no UTF-8 text has it
    owner = np.repeat(np.arange(n), lens)
    place = np.arange(upto[-1]) + owner
    raw[place] = data
    start = (np.arange(upto[-1]) + window <= upto[owner + 1])  # where windows start
    symbols = raw.astype(np.int32) + 2
    symbols[raw == 0xFF] = 1
    sa = suffix_array(np.append(symbols, np.int32(0)))[1:]
    joined = shares_prefix(raw, sa, window)
    of = np.full(len(raw), -1, dtype=np.int64)               # number of the window that starts here
    of[place[start]] = np.arange(start.sum())
    ordered = of[sa]
    here = ordered >= 0
    ordered, follows = ordered[here], joined[sa[here]]
    group = np.flatnonzero(~follows)
    ids = least[owner[start]]
    out = np.empty(len(ids), dtype=np.int64)
    if len(ids):
        low = np.minimum.reduceat(ids[ordered], group)
        out[ordered] = np.repeat(low, np.diff(np.append(group, len(ordered))))
    return out


def _answers(window: int):
    """A shard's segments -> (pack, shard, runs, lengths, least): the windows of each segment as runs of equal answers."""
    def answer(group: pa.Table) -> pa.Table:
        from blotter.llm.textbytes import range_hash, running
        columns = {k: group.column(k).to_pylist() for k in ("pack", "hashes", "least", "lens", "data")}
        read = lambda k, kind: [np.frombuffer(b, dtype=kind) for b in columns[k]]
        hashes, least, lens = read("hashes", U64), read("least", np.int64), read("lens", np.int16)
        each = [len(x) for x in hashes]
        h, low, size = np.concatenate(hashes), np.concatenate(least), np.concatenate(lens).astype(np.int64)
        data = np.concatenate(read("data", np.uint8))
        upto = np.concatenate(([0], np.cumsum(size)))
        content, i = np.empty(len(h), dtype=U64), 0
        while i < len(h):                              # a few segments at a time: the sums take eight bytes a byte
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + SORT, side="right")) - 1)
            content[i:j] = range_hash(running(data[upto[i]:upto[j]]), upto[i:j] - upto[i], upto[i + 1:j + 1] - upto[i])
            i = j
        order = np.lexsort((low, content, h))
        new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (content[order][1:] != content[order][:-1]))) if len(h) else np.zeros(0, dtype=bool)
        pick = order[new]
        which = np.empty(len(h), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        # one suffix array for whole anchors, up to SORT bytes together
        anchor = np.flatnonzero(np.concatenate(([True], h[pick][1:] != h[pick][:-1]))) if len(pick) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate(([0], np.cumsum(size[pick])))
        none = np.zeros(0, dtype=np.int64)
        values, lengths, counts, i = [none], [none], [none], 0
        while i < len(pick):
            nxt = anchor[np.searchsorted(ends[anchor], ends[i] + SORT, side="right") - 1] if len(anchor) else len(pick)
            j = len(pick) if ends[-1] - ends[i] <= SORT else int(nxt)
            if j <= i:  # one anchor with more: only if a single window is
                after = np.searchsorted(anchor, i, side="right")
                j = int(anchor[after]) if after < len(anchor) else len(pick)
            part = pick[i:j]
            take = np.repeat(upto[part] - (ends[i:j] - ends[i]), size[part]) + np.arange(ends[j] - ends[i])
            value = equal_windows(size[part], data[take], low[part], window)
            seg = np.repeat(np.arange(len(part)), size[part] - window + 1)
            first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (seg[1:] != seg[:-1])))) if len(value) else none
            values.append(value[first])
            lengths.append(np.diff(np.append(first, len(value))))
            counts.append(np.bincount(seg[first], minlength=len(part)))
            i = j
        run_value, run_len, runs = np.concatenate(values), np.concatenate(lengths), np.concatenate(counts)
        run_at = np.concatenate(([0], np.cumsum(runs)))
        cells: list[list[bytes]] = [[], [], []]
        at = 0
        for n in each:
            w = which[at:at + n]
            at += n
            k = runs[w]
            take = np.repeat(run_at[w] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            for cell, x in zip(cells, (k.astype(np.uint8), run_len[take].astype(np.uint8), run_value[take])):
                cell.append(x.tobytes())
        shard = group.column("shard")[0].as_py()
        return pa.table([pa.array(columns["pack"], pa.int64()), pa.array([shard] * len(each), pa.int64()),
                         *(pa.array(c, pa.binary()) for c in cells)], names=["pack", "shard", "runs", "lengths", "least"])
    return answer


def _cut(shards: int, window: int, texts: bool):
    """Packs with their answers -> one row per document."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Segments(row, shards, window)
            pack, parts = s.pack, sorted(row["answers"] or [], key=lambda x: x["shard"])
            edge = np.zeros(len(pack.data) + 1, dtype=np.int32)
            if parts:
                read = lambda k, kind: np.concatenate([np.frombuffer(p[k], dtype=kind) for p in parts])
                runs, length, least = read("runs", np.uint8).astype(np.int64), read("lengths", np.uint8).astype(np.int64), read("least", np.int64)
                at = np.concatenate(([0], np.cumsum(runs)))
                before = np.cumsum(length) - length
                before -= np.repeat(before[at[:-1]], runs)   # windows of the segment before this run
                k = runs[s.which]
                take = np.repeat(at[s.which] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                doc, start = np.repeat(s.doc, k), np.repeat(s.first, k) + before[take]
                gone = least[take] < pack.ids[doc]
                np.add.at(edge, start[gone], 1)
                np.add.at(edge, (start + length[take] + window - 1)[gone], -1)
            covered = np.cumsum(edge[:-1]) > 0
            digests = row["digests"].hex()
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "digest", "kept")}
            for i, (a, b) in enumerate(zip(pack.offsets[:-1].tolist(), pack.offsets[1:].tolist())):
                c = np.ones(b - a, dtype=bool) if pack.copied[i] and b - a >= window else covered[a:b]
                kept = pack.data[a:b][~c].tobytes()
                out["doc_id"].append(None if pack.ids[i] == NO_ID else int(pack.ids[i]))
                out["n_bytes"].append(b - a)
                out["n_removed"].append(int(c.sum()))
                out["n_spans"].append(int((c[1:] & ~c[:-1]).sum() + (len(c) > 0 and c[0])))
                out["digest"].append(digests[32 * i:32 * i + 32])
                out["kept"].append(kept.decode("utf-8", "ignore") if texts else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in list(out.values())[:4]),
                                              *(pa.array(out[k], pa.string()) for k in ("digest", "kept"))], list(out))
    return make


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW,
                   texts: bool = False) -> DataFrame:
    """(doc_id, digest, n_bytes, n_removed, n_spans, kept): kept is the SHA-256 of the remaining bytes in hex, or (``texts``)
    the remaining text, without what a cut has left of a character. digest: of the whole text, half its SHA-256 in hex."""
    if not GRAM + 8 <= window <= 128:
        raise ValueError("windows of 24 to 128 bytes")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(docs[id_column].cast("long").alias("doc_id"), text_of(docs, text_column).alias("text"))
    packed = given.mapInArrow(lambda b: _packs(b, window), "pack long, bytes long, ids binary, lens binary, digests binary, counts binary, gaps binary, windows binary, data binary")
    name = f"packs_{uuid.uuid4().hex}"
    path = shared_dir(spark, "packs")
    packed.write.option("path", path).option("compression", "zstd").bucketBy(parts, "pack").saveAsTable(name)
    packs = spark.table(name)
    shards = max(parts, -(-(packs.agg(F.sum("bytes")).first()[0] or 0) // SHARD))
    packs = packs.drop("bytes")
    try:
        copies = written(_copies(packs), "packs-copies")
        known = packs.join(copies.hint("shuffle_hash"), "pack", "left")
        told = known.mapInArrow(_told(shards, window), "shard long, pack long, hashes binary, many binary, more binary")
        repeated = told.groupBy("shard").applyInArrow(_repeated(window), "pack long, shard long, hashes binary").filter("length(hashes) > 0")
        repeated = written(repeated.groupBy("pack").agg(F.collect_list(F.struct("shard", "hashes")).alias("repeated")), "packs-repeated")
        known = known.join(repeated.hint("shuffle_hash"), "pack", "left")
        sent = known.mapInArrow(_sent(shards, window), "shard long, pack long, hashes binary, least binary, lens binary, data binary")
        answers = sent.groupBy("shard").applyInArrow(_answers(window), "pack long, shard long, runs binary, lengths binary, least binary")
        answers = answers.groupBy("pack").agg(F.collect_list(F.struct("shard", "runs", "lengths", "least")).alias("answers"))
        answers = written(answers, "packs-answers")
        known = known.join(answers.hint("shuffle_hash"), "pack", "left")
        return written(known.mapInArrow(_cut(shards, window, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, digest string, kept string"), "packs-kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def _copies(packs: DataFrame) -> DataFrame:
    """(pack, copies): the places in each pack of documents that equal one with a smaller id."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids = np.frombuffer(row["ids"], dtype=np.int64)
            d = np.frombuffer(row["digests"], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["pack"])), pa.array(np.arange(len(ids))), pa.array(ids), pa.array(d[:, 0]), pa.array(d[:, 1])],
                                             ["pack", "place", "id", "d1", "d2"])

    rows = packs.select("pack", "ids", "digests").mapInArrow(make, "pack long, place long, id long, d1 long, d2 long")
    rows = written(rows, "packs-digests")
    least = rows.groupBy("d1", "d2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(least, ["d1", "d2"]).filter("id > least").groupBy("pack").agg(F.sort_array(F.collect_list("place")).alias("copies"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with what remains of each text (a null text stays null)."""
    kept = remove_repeats(docs, window=window, texts=True).dropDuplicates(["doc_id", "digest"])
    digest = F.substring(F.sha2(text_of(docs).cast("binary"), 256), 1, 32)
    rows = boxed(docs, of=digest, none=docs["text"].isNull())
    rows = rows.withColumn("row", F.col("row").dropFields("text"))  # the remaining text comes with the answers
    rows = rows.join(kept, F.col("row.doc_id").cast("long").eqNullSafe(kept["doc_id"]) & (rows["of"] == kept["digest"]))
    text = F.when(~F.col("none"), F.col("kept"))
    return rows.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
