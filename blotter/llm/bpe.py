"""Byte-level BPE token ids of whole texts, for many texts at once.

The ids are those of the ``tokenizers`` library for the given vocabulary file.
That library spends its time on the same few pieces again and again, so texts
are first cut into pieces (the byte-level pattern's words, in numpy over code
points), each different piece is encoded once, and the ids of a text are put
together from its pieces.  Pieces are looked up by a hash and then compared
character by character; one that has another piece's hash is encoded by itself.  Where the vocabulary's ids are the ranks of its
merges, ``tiktoken`` encodes the pieces from the same ranks, four times as
fast; this is tried against the library on the vocabulary itself.  Texts with characters beyond those
whose class never changes between Unicode versions go to the library whole.
"""

from __future__ import annotations

import numpy as np

from blotter.llm.textbytes import U64, mix, powers

LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 0
PLAIN = 0x250           # code points below: Latin scripts
# Fixed value: the pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 19         # characters cut at a time
MOST_PIECES = 1_000_000  # known pieces kept by a worker (about 60 MB); beyond it starts anew, with the same results


def _classes() -> np.ndarray:
    """Of the code points below PLAIN and the general punctuation block."""
    import regex
    out = np.zeros(0x2070, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\p{White_Space}")):
        match = regex.compile(pattern).match
        out[[c for c in range(len(out)) if match(chr(c))]] = kind
    return out


def cut(cp: np.ndarray, begin: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First positions of the pieces of concatenated texts (code points; first positions of the texts that aren't empty)."""
    n = len(cp)
    c = classes[cp]
    fresh = np.zeros(n + 1, dtype=bool)    # a text begins here, or all has ended
    fresh[begin], fresh[n] = True, True
    change = fresh[:n].copy()
    change[1:] |= c[1:] != c[:-1]
    white = c == WHITE
    start = change.copy()
    # The last white space before anything else of its text is a piece of its own, or opens the next one if a blank.
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = white[:-1] & ~white[1:] & ~fresh[1:n]
    at = np.flatnonzero(follows)
    start[at] = True
    start[at[cp[at] == 0x20] + 1] = False
    # Contractions: an apostrophe that begins a piece, and s, t, m, d, re, ve or ll.
    mark = np.flatnonzero((cp[:-1] == 0x27) & start[:-1] & ~fresh[1:n]) if n > 1 else np.zeros(0, dtype=np.int64)
    if len(mark):
        one = cp[mark + 1]
        has_two = (mark + 2 < n) & ~fresh[np.minimum(mark + 2, n)]
        two = np.where(has_two, cp[np.minimum(mark + 2, n - 1)], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[mark[short | long] + 1] = False
        for hit, step in ((short, 2), (long, 3)):
            after = mark[hit] + step
            # What follows begins a piece, unless it is a white space run's inside (which begins there anyway).
            start[after[after < n]] = True
    return np.flatnonzero(start)


def _equal(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which ranges of ``a`` hold the same values as their ranges of ``b``; a part of the ranges at a time."""
    out = a_size == b_size
    rows = np.flatnonzero(out & (a_size > 0))
    upto = np.concatenate(([0], np.cumsum(a_size[rows])))
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + CHUNK, side="right")) - 1)
        part = rows[i:j]
        size = a_size[part]
        first = upto[i:j] - upto[i]
        step = np.arange(upto[j] - upto[i]) - np.repeat(first, size)
        differs = a[np.repeat(a_at[part], size) + step] != b[np.repeat(b_at[part], size) + step]
        out[part] = ~np.logical_or.reduceat(differs, first)
        i = j
    return out


def _ranked(library, vocabulary: dict[str, int]):
    """The vocabulary as a tiktoken encoding, or None if that gives other ids."""
    import tiktoken
    # The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in vocabulary.items() if all(c in byte for c in piece)
             and piece != "<|endoftext|>"}
    if not all(bytes([b]) in ranks for b in range(256)):
        return None
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = [p.decode("utf-8", "ignore") * k for p in list(ranks)[::61] for k in (1, 2)]
    same = [e.ids for e in library.encode_batch_fast(some, add_special_tokens=False)] == [own.encode_ordinary(x) for x in some]
    return own if same else None


class Encoder:
    """Token ids of texts; keeps the pieces it has seen."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.library.get_vocab_size()
        self.ranked = _ranked(self.library, self.library.get_vocab())
        self.classes = _classes()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.text, self.text_used = np.zeros(1 << 16, dtype=np.uint16), 0    # the pieces' code points
        self.text_at, self.text_size = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return list(map(self.ranked.encode_ordinary, pieces))
        return [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids = self._ids(pieces)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        new = np.fromiter((x for i in ids for x in i), dtype=np.int32, count=int(size.sum()))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used:self.used + len(new)] = new
        at = self.used + np.cumsum(size) - size
        self.used += len(new)
        letters = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32).astype(np.uint16)
        while self.text_used + len(letters) > len(self.text):
            self.text = np.concatenate((self.text, np.zeros_like(self.text)))
        self.text[self.text_used:self.text_used + len(letters)] = letters
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        text_at = self.text_used + np.cumsum(length) - length
        self.text_used += len(letters)
        where = np.searchsorted(self.keys, keys)
        self.text_at, self.text_size = np.insert(self.text_at, where, text_at), np.insert(self.text_size, where, length)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has) for texts whose characters all have a class."""
        joined = "".join(texts)
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        if not joined:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        begin = np.cumsum(length) - length
        start = cut(cp, begin[length > 0], self.classes)
        end = np.append(start[1:], len(cp))
        sums = np.zeros(len(cp) + 1, dtype=U64)
        up, down = powers(len(cp) + 1)
        np.cumsum((cp.astype(U64) + U64(1)) * up[:len(cp)], out=sums[1:])
        key, first, back = np.unique(mix((sums[end] - sums[start]) * down[start]), return_index=True, return_inverse=True)
        if len(self.keys) + len(key) > MOST_PIECES:
            self._clear()
        place = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == key[inside]
        if not known.all():
            new = first[~known]
            self._learn(key[~known], [joined[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())])
            place = np.searchsorted(self.keys, key)
        entry = place[back]
        flat, at, size = self.flat, self.at[entry].astype(np.int64), self.size[entry].astype(np.int64)
        # A hash is no proof: every piece is compared with the one whose ids it would get.
        same = _equal(cp, start, end - start, self.text, self.text_at[entry].astype(np.int64), self.text_size[entry].astype(np.int64))
        if not same.all():
            bad = np.flatnonzero(~same)
            own = self._ids([joined[a:b] for a, b in zip(start[bad].tolist(), end[bad].tolist())])
            size[bad] = [len(x) for x in own]
            at[bad] = self.used + np.cumsum(size[bad]) - size[bad]
            flat = np.concatenate((flat[:self.used], np.array([x for ids in own for x in ids], dtype=np.int32)))
        upto = np.cumsum(size)
        ids = flat[np.repeat(at - (upto - size), size) + np.arange(upto[-1])]
        total = np.concatenate(([0], upto))
        text_at = np.searchsorted(start, np.append(begin, len(cp)))
        return ids, np.diff(total[text_at])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (int32)."""
        out: list[np.ndarray | None] = [None] * len(texts)
        run: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal run, held
            if run:
                ids, n = self._plain([texts[i] for i in run])
                for i, part in zip(run, np.split(ids, np.cumsum(n)[:-1])):
                    out[i] = part
            run, held = [], 0

        for i, t in enumerate(texts):
            if t.isascii() or self._classed(t):
                run.append(i)
                held += len(t)
                if held >= CHUNK:
                    flush()
            else:
                out[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, dtype=np.int32)
        flush()
        return out

    def _classed(self, text: str) -> bool:
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        return bool(((cp < PLAIN) | ((cp >= 0x2010) & (cp < 0x2060))).all())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
