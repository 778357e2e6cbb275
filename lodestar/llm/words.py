"""Vectorised word and window hashes of Arrow text batches (numpy inside Spark tasks)."""

from __future__ import annotations

import hashlib

import numpy as np

#: Fixed random constants of the hashes.
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Words of more bytes are hashed by blake2b.
LONG = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64 for i < n at least; kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        have = _powers[base] = tuple(both)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result hangs on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """Hashes of any stretch of a sequence of 64-bit symbols, from running sums."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        base = _BASES[which]
        n = len(symbols)
        power, self.inverse = powers(base, n + 1)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(symbols * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of symbols[start:stop]; equal stretches have equal hashes wherever they stand."""
        raw = (self.sums[stop] - self.sums[start]) * self.inverse[start]
        return mixed(raw + (stop - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def bytes_symbols(raw: np.ndarray, which: int = 0) -> np.ndarray:
    return _TABLE[which][raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, text number) of the words, maximal stretches without ASCII white space, of texts raw[offsets[i]:offsets[i+1]]."""
    if not len(raw):
        none = np.empty(0, np.int64)
        return none, none, none
    word = ~_SPACE[raw]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    begin[first] = word[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = word[last]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(raw: np.ndarray, offsets: np.ndarray, which: int = 0) -> tuple[np.ndarray, ...]:
    """(hash, start, stop, text number) of every word."""
    start, stop, text = word_spans(raw, offsets)
    h = Prefix(bytes_symbols(raw, which), which).of(start, stop)
    for i in np.flatnonzero(stop - start > LONG):  # sums of powers modulo 2 ** 64 only tell short words apart
        h[i] = np.frombuffer(hashlib.blake2b(raw[start[i] : stop[i]].tobytes(), digest_size=8, person=bytes([which])).digest(), np.uint64)[0]
    return h, start, stop, text


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of k words; a text of fewer words, but not none, has one of all its words."""
    h, _, _, text = word_hashes(raw, offsets)
    texts = len(offsets) - 1
    count = np.bincount(text, minlength=texts)
    first = np.concatenate([[0], np.cumsum(count)])
    runs = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
    of = np.repeat(np.arange(texts), runs)
    start = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs) + first[of]
    return Prefix(h, 1).of(start, np.minimum(start + k, first[of + 1])), of


def counted(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, group, count) of the distinct pairs, sorted by group, then key."""
    if not len(keys):
        return keys, group, np.empty(0, np.int64)
    order = np.lexsort((keys, group))
    k, g = keys[order], group[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (g[1:] != g[:-1])]))
    return k[new], g[new], np.diff(np.concatenate([new, [len(k)]]))
