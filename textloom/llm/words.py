"""Word hashing in bulk: whole Arrow batches at a time, without a Python step per word.

A word is a maximal run of ASCII letters and digits, and of any non-ASCII characters, after
Unicode lower-casing. Scripts written without spaces make one word of each run between ASCII
separators. Null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20  # bytes of text hashed at once; bounds the temporary arrays, not the input
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def word_bytes() -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[48:58] = lut[65:91] = lut[97:123] = lut[128:] = True
    return lut


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one array, and the n + 1 offsets of the rows in it."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(o):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def slices(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole rows of about `most` bytes, each with the number of its first row; a longer row comes alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, o = text_bytes(texts)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(o, o[at] + most, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


class Hasher:
    """Hashes the words of rows of text. One instance for each task: it keeps tables of powers."""

    def __init__(self):
        self.lut, self.pow, self.inv = word_bytes(), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, CHUNK + 1)
            self.pow, self.inv = powers(_P, n), powers(_P_INV, n)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, word offsets of the rows). Meant for one slice of about CHUNK bytes."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        b, o = text_bytes(pc.utf8_lower(texts))
        if not len(b):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        w = self.lut[b]
        self._powers(len(b) + 1)
        first = w.copy()
        first[1:] &= ~w[:-1]
        inner = o[1:-1]
        inner = inner[inner < len(b)]
        first[inner] = w[inner]
        start = np.flatnonzero(first)
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.pow[: len(b)] * w, out=total[1:])
        # Bytes between words add nothing, so a word ends, as far as the sum goes, where the next starts.
        end = np.append(start[1:], len(b))
        h = mix((total[end] - total[start]) * self.inv[start])
        return h, np.searchsorted(start, o)


def kmers(h: np.ndarray, o: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a row, with the row and the place in it of each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = np.zeros(n, np.uint64)
    for j in range(k):
        v = v * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    row = np.repeat(np.arange(len(o) - 1), np.diff(o))[:n]
    place = np.arange(n)
    ok = place + k <= o[row + 1]
    return mix(v[ok]), row[ok], place[ok] - o[row[ok]]


def shingles(h: np.ndarray, o: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As kmers, but a row of 1 to k - 1 words has one shingle, of all its words. (hashes, offsets)."""
    v, row, _ = kmers(h, o, k)
    n = np.diff(o)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            at = o[short] + j
            has = j < n[short]
            extra = np.where(has, extra * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(at, len(h) - 1)], extra)
        at = np.searchsorted(row, short)
        v, row = np.insert(v, at, mix(extra ^ np.uint64(k))), np.insert(row, at, short)
    return v, np.searchsorted(row, np.arange(len(o)))
