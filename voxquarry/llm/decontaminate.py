"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

A region within e edits of an item of m characters shares m - q + 1 - q * e of its q-grams with it, on at most e + 1
neighbouring diagonals (document position less item position). Shared q-grams are counted in overlapping bands of
diagonals; bands that reach the bound are aligned with the item inside the band. Texts are compared as UTF-8, A-Z
and U+00C0 to U+00DE lower-cased, each ASCII white-space character as a blank.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxquarry.llm import arrays
from voxquarry.llm.common import materialise, table

Q, EDITS = 10, 0.08
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is worked through in blocks of about so many.
BLOCK_BYTES = 4 << 20
FILTER_BITS = 20
#: Shared q-grams that are held at once, those of one q-gram in one text that are listed one by one (more are counted by
#: cells), and the widest band of diagonals that is aligned at once.
HITS, LISTED, WIDEST = 1 << 21, 1 << 16, 1 << 16


def normal(buf: np.ndarray) -> np.ndarray:
    b = arrays.lower(buf)
    latin = np.zeros(len(b), bool)  # capital letters of U+00C0 to U+00DE: 0xC3 and 0x80 to 0x9E
    latin[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    return np.where((b >= 9) & (b <= 13), np.uint8(32), b + latin.astype(np.uint8) * np.uint8(32))


def qgrams(b: np.ndarray, q: int) -> np.ndarray:
    n = len(b) - q + 1
    v = np.zeros(max(n, 0), np.uint64)
    for k in range(q if n > 0 else 0):
        v = v * np.uint64(0x9E3779B97F4A7C15) + b[k : n + k]
    return v


def edit_budget(m: int, q: int, edits: float) -> int:
    """Edits allowed for an item of m bytes: `edits` of it, as far as the lemma's bound stays positive."""
    return max(0, min(int(edits * m), (m - q) // q))


class Items:
    """q-gram index of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]], q: int, edits: float):
        self.q = q
        self.ids = [i for i, _ in items]
        self.texts = [normal(np.frombuffer(t, np.uint8)) for _, t in items]
        self.budget = np.array([edit_budget(len(t), q, edits) for t in self.texts], np.int64)
        self.need = np.array([max(1, len(t) - q + 1 - q * e) for t, e in zip(self.texts, self.budget, strict=True)], np.int64)
        self.longest = max((len(t) for t in self.texts), default=0)
        self.short = [k for k, t in enumerate(self.texts) if 0 < len(t) < q]
        grams = [qgrams(t, q) for t in self.texts]
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.gram, first, count = np.unique(gram[order], return_index=True, return_counts=True)
        self.first, self.count = first, count
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.gram * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, b: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text position, indexed q-gram) of every q-gram that lies in one row and in an item."""
        g = qgrams(b, self.q)
        at = np.flatnonzero(self.filter[(g * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] & (rows[: len(g)] == rows[self.q - 1 :][: len(g)]))
        if not len(self.gram):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
        ok = self.gram[k] == g[at]
        return at[ok], k[ok]

    def cells(self, b: np.ndarray, rows: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """(key of row, item and cell of e + 1 diagonals; shared q-grams in it, at least as many as there are).

        A q-gram that is frequent in a text and in an item is not listed by pairs of positions: its positions are counted
        by cells of both, so that a repetitive text costs time and memory in proportion to its length.
        """
        at, k = self.hits(b, rows)
        n = self.count[k]
        _, group, size = np.unique(rows[at] * (len(self.gram) + 1) + k, return_inverse=True, return_counts=True)
        often = n * size[group] > LISTED
        keys, counts = [], []
        one, gram = at[~often], k[~often]
        ends = np.cumsum(self.count[gram])
        i = 0
        while i < len(one):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS, side="right")))
            n = self.count[gram[i:j]]
            where = np.repeat(self.first[gram[i:j]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            pos = np.repeat(one[i:j], n)
            item = self.item[where]
            key, count = np.unique(self.key(rows[pos], item, (pos - self.pos[where] + self.longest) // (self.budget[item] + 1), base), return_counts=True)
            keys.append(key)
            counts.append(count)
            i = j
        for g in np.unique(group[often]):
            own = at[group == g]
            held = slice(int(self.first[k[group == g][0]]), int(self.first[k[group == g][0]] + self.count[k[group == g][0]]))
            for item in np.unique(self.item[held]):
                step = int(self.budget[item]) + 1
                places = (own + self.longest) // step
                low = int(places[0])
                mine = self.pos[held][self.item[held] == item] // step
                spread = np.convolve(np.bincount(places - low), np.bincount(mine.max() - mine))  # by difference of cells
                diff = low - int(mine.max()) + np.arange(len(spread))
                some = spread > 0
                for d in (diff[some], diff[some] - 1):  # a diagonal's cell is the difference or one below
                    keys.append(self.key(rows[own[0]], item, d, base))
                    counts.append(spread[some])
        if not keys:
            return at[:0], at[:0]
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)

    def key(self, row, item, cell, base: int):
        return (row * len(self.texts) + item) * base + cell + 2

    def bands(self, b: np.ndarray, rows: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """First and last diagonals, by (row, item), where two neighbouring cells hold enough shared q-grams; those that touch are one."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        base = len(b) + self.longest + 8
        key, count = self.cells(b, rows, base)
        if not len(key):
            return out
        both = count.copy()
        follows = np.flatnonzero(key[1:] == key[:-1] + 1)
        both[follows] += count[follows + 1]
        it = key // base % len(self.texts)
        for k in np.flatnonzero(both >= self.need[it]):
            i, s = int(it[k]), int(self.budget[it[k]]) + 1
            lo = (int(key[k] % base) - 2) * s - self.longest
            # the alignment may leave the diagonals of its shared q-grams by the budget, to either side
            held = out.setdefault((int(key[k] // base // len(self.texts)), i), [])
            lo, hi = lo - s + 1, lo + 3 * s - 2
            if held and lo <= held[-1][1] + 1 and hi - held[-1][0] < WIDEST:
                held[-1] = (held[-1][0], hi)
            else:
                held.append((lo, hi))
        return out

    def align(self, b: np.ndarray, start: int, end: int, i: int, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best region of b[start:end] for item i on diagonals lo..hi (all positions in b), or None over budget."""
        t = self.texts[i]
        width, far = hi - lo + 1, len(t) + 1
        # cost[d]: edits to match the item so far, ending before text position j + lo + d; begin[d]: where that match began
        at = lo + np.arange(width)
        cost = np.where((at >= start) & (at <= end), 0, far)
        begin = at.copy()
        steps = np.arange(width)
        for j, c in enumerate(t):
            at = j + lo + steps
            inside = (at >= start) & (at < end)
            sub = np.where(inside, cost + (b[np.clip(at, 0, len(b) - 1)] != c), far)
            gone = np.append(cost[1:] + 1, far)  # item character without a partner: one diagonal down
            new, frm = np.where(gone < sub, gone, sub), np.where(gone < sub, np.append(begin[1:], 0), begin)
            # text characters without a partner: a running minimum along the band
            slack = new - steps
            best = np.minimum.accumulate(slack)
            source = np.maximum.accumulate(np.where(slack == best, steps, 0))
            cost, begin = best + steps, frm[source]
            if cost.min() > self.budget[i]:
                return None
        k = int(np.argmin(cost))
        return int(cost[k]), int(begin[k]), int(len(t) + lo + k)


_LAST: dict[str, Items] = {}


def _index(block: tuple[str, list[tuple[int | None, bytes]], int, float]) -> Items:
    """The index of a broadcast block of items; a Python worker keeps the last one that it built."""
    name, items, q, edits = block
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Items(items, q, edits)
    return _LAST[name]


def _leaks(items: Items, texts: pa.Array, all_hits: bool = True) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end) of each row and item that match; unless `all_hits`, something for each row that matches any."""
    for first, n, buf, offsets in arrays.chunks(texts):
        b = normal(buf)
        rows = np.repeat(np.arange(n), np.diff(offsets))
        bands = items.bands(b, rows)
        found, row, text = [], -1, b""
        done = set()
        for r, i in sorted([*bands, *((r, i) for r in range(n) for i in items.short)]):
            if not all_hits and r in done:
                continue
            start, end = int(offsets[r]), int(offsets[r + 1])
            if r != row:
                row, text = r, b[start:end].tobytes()
            t = items.texts[i]
            at = text.find(t.tobytes())
            best = (0, start + at, start + at + len(t)) if at >= 0 else None
            if best is None and items.budget[i]:
                best = min((x for x in (items.align(b, start, end, i, lo, hi) for lo, hi in bands[r, i]) if x is not None), default=None)
            if best is not None:
                found.append((r, i, *best))
                done.add(r)
        row = -1
        for r, i, edits, a, z in found:
            if r != row:
                row, chars = r, np.cumsum((buf[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)
            begin, stop = (int(chars[x - offsets[r] - 1]) if x > offsets[r] else 0 for x in (a, z))
            yield first + r, i, edits, begin, stop


def _find(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _index(held.value)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[r], items.ids[i], *rest) for r, i, *rest in _leaks(items, batch.column("text"))]
            names, kinds = ["doc_id", "item_id", "edits", "start", "end"], [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names)

    return run


def _keep(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _index(held.value)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[r for r, *_ in _leaks(items, batch.column("text"), all_hits=False)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _blocks(spark: SparkSession, benchmark: DataFrame, q: int, edits: float, block_bytes: int) -> Iterator:
    """Broadcasts of the benchmark's items, about `block_bytes` of text each (a longer item is one by itself at worst)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("length(text) > 0")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(((x["item_id"], x["text"].encode()) for x in own.toLocalIterator()), key=lambda x: (x[0] is None, x))
        if rows or blocks == 1:
            yield spark.sparkContext.broadcast((uuid.uuid4().hex, rows, q, edits))


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, edits, start, end) for each document and item with a region within the item's edit budget.

    The budget is floor(edits * bytes of the item), less where the lemma would allow no bound; items of fewer than q bytes
    must occur exactly; null and empty items and texts match nothing. The region is the one of fewest edits, the first of
    equals, in characters from 0 to before `end`. Each repeated document or item row matches by itself; null ids stay
    null. The benchmark is broadcast in blocks of about `block_bytes`, as many as its size needs, each met by all
    documents; with several, a block's matches are written before the next block is sent.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    out, last = None, None
    for held in _blocks(docs.sparkSession, benchmark, q, edits, block_bytes):
        if last is not None:
            out = materialise(out, "leaks")
            last.unpersist()
        found = docs.mapInArrow(_find(held), "doc_id long, item_id long, edits long, start long, end long")
        out, last = found if out is None else out.unionByName(found), held
    return out


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs (text, ...) without a benchmark passage (see find_leaks); null texts stay. Nothing is shuffled."""
    last = None
    for held in _blocks(docs.sparkSession, benchmark, q, edits, block_bytes):
        if last is not None:
            docs = materialise(docs, "clean")
            last.unpersist()
        docs, last = docs.mapInArrow(_keep(held), docs.schema), held
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
