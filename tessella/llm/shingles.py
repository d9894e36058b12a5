"""Word n-grams of many texts as 64-bit hashes, found with NumPy."""

from __future__ import annotations

import numpy as np

from .tokens import mixed, powers

#: Words per n-gram.
WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def batches(texts: list[bytes], most: int = 1 << 19):
    """Slices of texts of about most bytes (a longer text alone)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word; its place in the texts joined by one byte each; where each text's words begin, and their number)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(lengths)
    word = ~_SPACE[joined]
    step = np.diff(word.astype(np.int8), prepend=np.int8(0))
    start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = powers(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
    words = mixed((sums[stop] - sums[start]) * up[start]) ^ (stop - start).astype(np.uint64)
    cuts = np.searchsorted(start, np.append(0, ends))
    return words, start, cuts


def word_counts(texts: list[bytes]) -> np.ndarray:
    """The number of words of each text."""
    word = ~_SPACE[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    start = np.flatnonzero(word & ~np.append(False, word[:-1]))
    return np.diff(np.searchsorted(start, np.append(0, np.cumsum([len(t) + 1 for t in texts]))))


def ngrams(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams, text by text, with repeats; their number per text).

    Words are maximal runs of other bytes than ASCII white space.  A text of
    fewer than n words has one n-gram of them all, one without words has none.
    """
    words, _, cuts = word_hashes(texts)
    count = np.diff(cuts)
    total = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.zeros(int(total.sum()), np.uint64)
    full = np.maximum(count - n + 1, 0)
    first = np.repeat(cuts[:-1], full) + (np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full))
    h = np.zeros(len(first), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[first + k]
    place = np.repeat(np.cumsum(total) - total, full) + (np.arange(len(first)) - np.repeat(np.cumsum(full) - full, full))
    out[place] = mixed(h)
    for t in np.flatnonzero((count > 0) & (count < n)).tolist():
        h1 = np.uint64(int(count[t]))
        for w in words[cuts[t] : cuts[t + 1]]:
            h1 = np.uint64((int(h1) * 0x9E3779B97F4A7C15 + int(w)) & ((1 << 64) - 1))
        out[(np.cumsum(total) - total)[t]] = mixed(np.array([h1], np.uint64))[0]
    return out, total


def sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    out = []
    for a, b in batches(texts):
        flat, total = ngrams(texts[a:b], n)
        out += [np.unique(x) for x in np.split(flat, np.cumsum(total)[:-1])]
    return out
