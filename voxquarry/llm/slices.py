"""Slices of a batch's bytes: places where every tokenizer splits, and slices told apart by their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from voxquarry.llm import arrays

#: Lead bytes of characters that are no white space in any Unicode version (U+00C0 to U+0FFF, U+4000 to U+EFFF, U+10000 on), and printable ASCII.
INK = np.zeros(256, bool)
INK[0x21:0x7F] = INK[0xC3:0xE1] = INK[0xE4:0xEF] = INK[0xF0:0xF5] = True


def cuts(buf: np.ndarray) -> np.ndarray:
    """Places of blanks that follow a character which is certainly no white space. What stands before a cut never changes
    how byte-level BPE or pieces without inner blanks split what follows, nor the other way round."""
    at = np.flatnonzero(buf[1:] == 32) + 1
    tail = lambda k: buf[np.maximum(at - k, 0)]
    lead = tail(1)
    for k in (2, 3, 4):
        lead = np.where((lead >= 0x80) & (lead < 0xC0), tail(k), lead)
    return at[INK[lead]]


def parts(buf: np.ndarray, most: int = arrays.CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of one text that are cut at `cuts`, of `most` bytes or up to the first cut beyond."""
    begin = 0
    while len(buf) - begin > most:
        look, end = begin + most, len(buf)
        while look < len(buf):
            found = cuts(buf[look - 4 : look + most])
            found = found[found >= 4]
            if len(found):
                end = look - 4 + int(found[0])
                break
            look += most - 4
        yield begin, end
        begin = end
    if begin < len(buf):
        yield begin, len(buf)


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct slices and, for each slice, its number among them. Hashes group, bytes decide."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    _, first, inverse = np.unique(arrays.word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    lens, rep = ends - starts, first[inverse]
    other = lens != lens[rep]
    n = np.where(other, 0, lens)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    unequal = buf[np.repeat(starts, n) + within] != buf[np.repeat(starts[rep], n) + within]
    if unequal.any():
        other[np.repeat(np.arange(len(n)), n)[unequal]] = True
    raw = buf.tobytes()
    out = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    if other.any():  # hashes that met: these slices get numbers of their own
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(other).tolist():
            piece = raw[int(starts[i]) : int(ends[i])]
            if piece not in known:
                known[piece] = len(out)
                out.append(piece)
            inverse[i] = known[piece]
    return out, inverse


class Memory:
    """A cache of results by slice in two generations of `most` entries: what is in use moves on, the rest is forgotten."""

    def __init__(self, most: int = 1 << 17):
        self.new: dict = {}
        self.old: dict = {}
        self.most = most

    def fill(self, keys: list[bytes], make) -> list:
        """The result of each key; make(missing keys) gives the missing ones."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    missing.append(k)
        if missing:
            new.update(zip(missing, make(missing), strict=True))
        return [new[k] for k in keys]


def ragged(values: list[bytes], dtype) -> pa.ListArray:
    """Lists of numbers from their bytes."""
    flat = np.frombuffer(b"".join(values), dtype)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // flat.itemsize
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(flat))
