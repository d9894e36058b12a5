"""Token ids of many texts at once, equal to the tokenizer's own.

Words repeat, so a word is encoded once per worker and looked up afterwards:
NumPy finds the words of a batch (as the tokenizer's pattern does), hashes them
and gathers the ids of the known ones through a hash table of arrays.  Texts with characters outside the plain
range below, or with the string of a special token, go through the tokenizer
itself.
"""

from __future__ import annotations

import re

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)

#: Texts of these characters only take the fast way: normalisation leaves them as they are, but for case and white space.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ž–—‘’“”•…€]*")
_CONTRACTED = {ord("s"): 1, ord("t"): 1, ord("m"): 1, ord("d"): 1}
_CONTRACTED_2 = {(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))}


#: Powers that a worker keeps, at most.
_KEPT = 600_000
_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i under n (kept for the next batch, unless they are many)."""
    global _POWERS
    if _POWERS is not None and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    made = np.cumprod(up), np.cumprod(down)
    if n <= _KEPT:
        _POWERS = made
    return made


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


class HashTable:
    """64-bit keys (not 0) to their numbers 0, 1, ...: open addressing in two arrays, all keys of a call at once."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        out, mask = np.full(len(keys), -1, np.int64), np.uint64((1 << self.bits) - 1)
        slot = keys & mask
        there = self.keys[slot]
        hit = there == keys
        out[hit] = self.rows[slot[hit]]
        left = np.flatnonzero(~hit & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + np.uint64(1)) & mask
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], slot[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number unknown, distinct keys in their order."""
        if 2 * (self.n + len(keys)) > 1 << self.bits:
            old = np.flatnonzero(self.keys)
            held, rows = self.keys[old], self.rows[old]
            self.bits = max(self.bits + 1, (4 * (self.n + len(keys))).bit_length() - 1)
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(held, rows)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        mask = np.uint64((1 << self.bits) - 1)
        slot = keys & mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of several keys for a slot one stays
            won = free & (self.keys[slot] == keys)
            self.rows[slot[won]] = rows[won]
            keys, rows, slot = keys[~won], rows[~won], (slot[~won] + np.uint64(1)) & mask


_HELD: dict[str, "WordTokenizer"] = {}


def word_tokenizer(path: str) -> "WordTokenizer":
    """The one tokenizer of this worker for a vocabulary: its known words outlive a task."""
    if path not in _HELD:
        _HELD[path] = WordTokenizer(path)
    return _HELD[path]


class WordTokenizer:
    """ids(texts) for a vocabulary that lower-cases, drops white space and merges within words.

    Memory is bounded: batch_chars characters at a time, and about so many known words.
    """

    def __init__(self, path: str, batch_chars: int = 1 << 19, words: int = 500_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same merges for words that are found and normalised already.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Strings that stand for one id wherever a text holds them; such texts go through the tokenizer.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.batch_chars, self.words = batch_chars, words
        points = [chr(i) for i in range(0x2100)]
        self.kind = np.array([0 if c.isspace() else 1 if c.isalpha() else 2 if c.isnumeric() else 3 for c in points], np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known = HashTable()
        self.first, self.count, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(8192, np.uint32)
        self.used = 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of them per word); words stand in one text, a blank between, as the tokenizer parts them there alike."""
        flat, counts = [], []
        for a in range(0, len(words), 1024):
            part = words[a : a + 1024]
            found = self.of_words.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            of = found.word_ids
            n = np.bincount(np.array(of, np.int64) if None not in of else np.zeros(0, np.int64), minlength=len(part))
            if len(n) != len(part) or not n.all():  # not parted as expected: word by word
                each = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids, n = np.array([i for x in each for i in x], np.uint32), np.array([*map(len, each)])
            flat.append(ids)
            counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        ids, counts = self._encoded(words)
        n, total = self.known.n, len(ids)
        while n + len(counts) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.count[n : n + len(counts)] = counts
        self.first[n : n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + total] = ids
        self.used += total
        self.known.add(hashes)

    def _starts(self, codes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 position of every word."""
        start = kind != 0
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        quotes = np.flatnonzero((codes[:-1] == 39) & (kind[1:] == 1) & start[:-1])
        for i in quotes.tolist():  # a lone apostrophe takes a contraction's letters
            n = _CONTRACTED.get(int(codes[i + 1]), 0)
            if not n and i + 2 < len(codes) and (int(codes[i + 1]), int(codes[i + 2])) in _CONTRACTED_2:
                n = 2
            if n:
                start[i + 1] = False
                if i + 1 + n < len(codes) and kind[i + 1 + n] == 1:
                    start[i + 1 + n] = True
        at = np.flatnonzero(start)
        edge = np.flatnonzero((kind[:-1] != 0) & (kind[1:] == 0)) + 1
        stops = np.append(at[1:], len(codes))
        if len(edge):
            nearest = np.searchsorted(edge, at, side="right")
            stops = np.minimum(stops, np.append(edge, len(codes))[nearest])
        return at, stops

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        """texts are plain and lower case."""
        lengths = np.array([len(t) + 1 for t in texts])
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[codes]
        at, stops = self._starts(codes, kind)
        up, down = powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
        hashes = mixed((sums[stops] - sums[at]) * up[at]) ^ (stops - at).astype(np.uint64)
        hashes[hashes == 0] = 1
        row = self.known.find(hashes)
        new = np.flatnonzero(row < 0)
        if len(new):
            unique, index = np.unique(hashes[new], return_index=True)
            if self.known.n + len(unique) > self.words:
                self._forget()
                row, new = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
                unique, index = np.unique(hashes, return_index=True)
            a, b = at[new[index]].tolist(), stops[new[index]].tolist()
            self._learn([joined[i:j] for i, j in zip(a, b, strict=True)], unique)
            row[new] = self.known.find(hashes[new])
        count = self.count[row].astype(np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.first[row] - (ends - count), count) + np.arange(total)]
        words_before = np.searchsorted(at, np.cumsum(lengths) - lengths)
        cuts = np.append(0, ends)[words_before]
        return np.split(ids, cuts[1:])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian uint32."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, chars = [], 0

        def flush() -> None:
            if plain:
                for k, found in zip([k for k, _ in plain], self._batch([t for _, t in plain]), strict=True):
                    out[k] = found
                plain.clear()

        for k, text in enumerate(texts):
            if _PLAIN.fullmatch(text) and not any(x in text for x in self.special):
                plain.append((k, text.lower()))
                chars += len(text)
                if chars >= self.batch_chars:
                    flush()
                    chars = 0
            else:
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        flush()
        return out
