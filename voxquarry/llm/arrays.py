"""Vectorised work on the UTF-8 bytes of a batch of texts: words, word hashes, shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """n pseudo-random words of splitmix64."""
    return mix64((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


_TABLE = stream64(64 * 256, 11)
_STEP = stream64(8, 12) | U(1)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row offsets into them) of at most CHUNK_BYTES or one row; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j - i, buf[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i])
        i = j


def lower(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than space and \\t..\\r, never over rows), and words per row."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    ink = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    before = np.empty(n, bool)
    before[0], before[1:] = False, ink[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    before[firsts] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, ink[1:]
    after[firsts[firsts > 0] - 1] = False
    ends = np.flatnonzero(ink & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets, side="left"))
    return starts, ends, counts


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a sum of random table entries by byte and position, mixed with the length."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    total = int(lens.sum())
    base = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    at = np.arange(total) + base
    pos = at - np.repeat(starts, lens)
    h = _TABLE[((pos & 63) << 8) | buf[at]]
    if int(lens.max()) > 64:
        h = h * (U(2) * (pos >> 6).astype(U) + U(1))
    return mix64(np.add.reduceat(h, np.cumsum(lens) - lens) + lens.astype(U) * U(0x9E3779B97F4A7C15))


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle; a row of 1..k-1 words has its whole sequence as one, an empty row none."""
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    parts_r, parts_h = [], []
    if len(hashes) >= k:
        h = np.zeros(len(hashes) - k + 1, U)
        for i in range(k):
            h += hashes[i : len(hashes) - k + 1 + i] * _STEP[i]
        ok = rows[: len(h)] == rows[k - 1 :]
        parts_r.append(rows[: len(h)][ok])
        parts_h.append(mix64(h[ok]))
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            h = np.full(len(short), U(m), U)
            for i in range(m):
                h += hashes[first[short] + i] * _STEP[i]
            parts_r.append(short)
            parts_h.append(mix64(h + U(0x51ED270B)))
    if not parts_r:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(parts_r), np.concatenate(parts_h)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: rows and hashes, sorted by both, and the size of each row's set."""
    buf = lower(buf)
    starts, ends, counts = words(buf, offsets)
    r, h = shingles(word_hashes(buf, starts, ends), counts, k)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    if len(r):
        new = np.empty(len(r), bool)
        new[0], new[1:] = True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        r, h = r[new], h[new]
    return r, h, np.bincount(r, minlength=len(offsets) - 1)


def set_digests(r: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each row's set, as two longs (0, 0 for an empty one)."""
    out = np.zeros((2, len(sizes)), U)
    some = np.flatnonzero(sizes)
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        for d, salt in zip(out, (0xA5A5, 0xC3C3C3), strict=True):
            d[some] = mix64(np.add.reduceat(mix64(h ^ U(salt)), first) + sizes[some].astype(U))
    return out[0].view(np.int64), out[1].view(np.int64)


def sequence_digests(w: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest, as two longs, of each sequence w[first:first+size] of word hashes; sequences of no word have (0, 0)."""
    out = np.zeros((2, len(sizes)), U)
    some = np.flatnonzero(sizes)
    if len(some):
        n = sizes[some]
        at = np.arange(int(n.sum())) + np.repeat(first[some] - (np.cumsum(n) - n), n)
        place = (at - np.repeat(first[some], n)).astype(U)
        for d, step in zip(out, (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03), strict=True):
            d[some] = mix64(np.add.reduceat(mix64(w[at] + place * U(step)), np.cumsum(n) - n) + n.astype(U))
    return out[0].view(np.int64), out[1].view(np.int64)


class Once:
    """Tells the digests that a task meets for the first time; forgets them after `most`, so that its memory is bounded."""

    def __init__(self, most: int = 1 << 16):
        self.seen: set[int] = set()
        self.most = most

    def new(self, digests: np.ndarray) -> np.ndarray:
        if len(self.seen) > self.most:
            self.seen.clear()
        return np.array([x not in self.seen and not self.seen.add(x) for x in digests.tolist()], bool)


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64))
