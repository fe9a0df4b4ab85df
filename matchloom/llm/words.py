"""Words of many texts at once: numpy over the UTF-8 bytes of a batch.

A word is a run of bytes other than space and U+0009 to U+000D, which is the same in bytes and in code points. A word's
64-bit hash takes its bytes eight at a time, each eight through a full finaliser (xxh3 for the rare word of over 64 bytes),
so unlike a polynomial it has no two families of words that it can't tell apart. Runs of words are hashed from the words'
hashes by doubling, again through the finaliser at each step; a second, independent combination gives 128 bits of a run.
``identities`` goes further for what one batch decides: it compares the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_LONG = 64  # bytes of a word that are hashed by numpy
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def paired(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of two hashes, in their order."""
    return mixed(mixed(a + np.uint64(salt)) * _STEP + b)


class Words:
    """The words of a batch of texts: begin and end (bytes of ``data``), and for each text its first word's number."""

    def __init__(self, data: np.ndarray, text_ends: np.ndarray):
        """text_ends: where each text ends in data; the texts follow one another."""
        self.data, self.text_ends = data, text_ends
        gap = GAP[data]
        # a word begins after a gap or where a text begins
        inside = ~gap
        begins = inside.copy()
        begins[1:] &= gap[:-1]
        firsts = text_ends[:-1]
        firsts = firsts[firsts < len(data)]
        begins[firsts] = inside[firsts]
        self.begin = np.nonzero(begins)[0]
        finishes = inside.copy()
        finishes[:-1] &= gap[1:]
        lasts = text_ends[(text_ends > 0)] - 1
        finishes[lasts] = inside[lasts]
        self.end = np.nonzero(finishes)[0] + 1
        self.first = np.concatenate([[0], np.searchsorted(self.begin, text_ends)]).astype(np.int64)
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(text_ends)), self.counts)

    @classmethod
    def of(cls, column: pa.Array, lower: bool = False) -> Words:
        """Of an Arrow string column without nulls. lower: A-Z are taken as a-z."""
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
        return cls(_LOWER[raw] if lower else raw, bounds[1:] - bounds[0])

    def _eights(self) -> np.ndarray:
        """The eight bytes that begin at each place of the data, as one number."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))

    def _eight(self, eights: np.ndarray, which: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of the given words, zeros beyond a word's end."""
        at = self.begin[which] + 8 * k
        left = np.clip(self.end[which] - at, 0, 8).astype(np.uint64)
        keep = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8) & np.uint64(63))) - np.uint64(1))
        return eights[np.minimum(at, len(self.data))] & keep

    def hashes(self, seed: int = 0) -> np.ndarray:
        size = (self.end - self.begin).astype(np.uint64)
        if not len(size):
            return size
        eights = self._eights()
        out = mixed(self._eight(eights, np.arange(len(size)), 0) + size * _STEP + np.uint64(seed))
        which, k = np.nonzero((size > 8) & (size <= _LONG))[0], 1
        while len(which):
            out[which] = mixed(out[which] * _STEP + self._eight(eights, which, k))
            k += 1
            which = which[size[which] > 8 * k]
        for i in np.nonzero(size > _LONG)[0].tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.begin[i] : self.end[i]].tobytes(), seed)
        return out

    def identities(self) -> np.ndarray:
        """Numbers that are equal exactly for equal words of the batch: hashes, after the words that share one have been
        compared. If two words did share one, the next seed is taken."""
        for seed in range(1 << 10):
            hashes = self.hashes(seed)
            order = np.argsort(hashes, kind="stable")
            same = hashes[order][1:] == hashes[order][:-1]
            if self._all_equal(order[:-1][same], order[1:][same]):
                return hashes
        raise AssertionError("no seed tells the words apart")

    def _all_equal(self, a: np.ndarray, b: np.ndarray) -> bool:
        size = self.end[a] - self.begin[a]
        if (size != self.end[b] - self.begin[b]).any():
            return False
        eights, k = self._eights(), 0
        some = np.nonzero(size <= _LONG)[0]
        while len(some):
            if (self._eight(eights, a[some], k) != self._eight(eights, b[some], k)).any():
                return False
            k += 1
            some = some[size[some] > 8 * k]
        return all(bytes(self.data[self.begin[i] : self.end[i]]) == bytes(self.data[self.begin[j] : self.end[j]]) for i, j in zip(a[size > _LONG].tolist(), b[size > _LONG].tolist(), strict=True))

    def windows(self, size: int, hashes: np.ndarray | None = None, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of `size` words within one text. Another salt: an independent hash of the run."""
        words = self.hashes() if hashes is None else hashes
        n = len(words) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        done, out, power, width = 0, None, words, 1  # power: runs of `width` words
        while True:
            if size & width:
                out = power[:n] if out is None else paired(out, power[done : done + n], salt)
                done += width
            if done == size:
                break
            power = paired(power[:-width], power[width:], salt + width)
            width *= 2
        at = np.nonzero(self.text_of[:n] == self.text_of[size - 1 :])[0]
        return at, (mixed(out + np.uint64(size + salt)) if size == 1 else out)[at]

    def joined(self, k: int, keep: np.ndarray | None = None) -> bytes:
        """Text k's words, or those with keep (by word number), joined by one space."""
        a, b = int(self.first[k]), int(self.first[k + 1])
        raw = memoryview(self.data)
        at = range(a, b) if keep is None else (a + np.nonzero(keep[a:b])[0]).tolist()
        begin, end = self.begin, self.end
        return b" ".join([bytes(raw[begin[i] : end[i]]) for i in at])
