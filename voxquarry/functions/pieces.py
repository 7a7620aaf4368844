"""Sub-word pieces under a table of pieces with scores: best segmentation, or merges in order of score.

Tokenizers are read, never trained. A text is cut before its blanks, as no piece has a blank behind other characters; each
distinct slice of some megabytes of text is segmented once, and remembered by its task. Merges of short slices are made for
all of them at once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "▁"
SLICES = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+$")
#: A character without a piece costs so much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Rows that a table of pieces may have, as it is broadcast.
MOST_PIECES = 1 << 20
#: Slices that a task remembers.
REMEMBERED = 1 << 18
#: Characters of text whose slices are segmented together, and rows of which so many are looked at for that.
TOGETHER, ROWS = 1 << 22, 64
#: Widths of the tables in which slices are merged at once, longer ones one by one; and their rows.
WIDTHS, TABLE_ROWS = (4, 8, 12, 16, 24, 32), 1 << 14
#: Stands for a mark of an unknown word among slices, which are never empty.
MARK = ""


class Pieces:
    """Segmentation by one table of (id, piece, score, kind)."""

    def __init__(self, model: str, rows: list[tuple[int, str, float, str]]):
        if model not in ("unigram", "bpe"):
            raise ValueError(f"no segmentation is known for a {model} model")
        self.segment: Callable[[str], list[int]] = self._best if model == "unigram" else self._merged
        self.pieces = {i: p for i, p, _, _ in rows}
        self.usable = {p: (s, i) for i, p, s, kind in rows if kind in ("normal", "own")}
        self.bytes = {int(p[3:5], 16): i for i, p, _, kind in rows if kind == "byte"}
        self.unknown = next((i for i, _, _, kind in rows if kind == "unknown"), 0)
        if any(BLANK in p.lstrip(BLANK) for p in self.usable):
            raise ValueError("a piece has a blank behind other characters")
        self.worst = min((s for s, _ in self.usable.values()), default=0.0) - UNKNOWN_PENALTY
        self.trie: dict = {}
        for piece, found in self.usable.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = found
        self.held: dict[str, bytes] = {}

    def _best(self, text: str) -> list[int]:
        """Ids of the segmentation with the highest sum of scores; unknown characters that stand together are one unknown piece.

        Forward over the places, down the trie from each; of equal sums the one whose last piece begins first.
        """
        n = len(text)
        total: list[float] = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        for i in range(n):
            node, j = self.trie, i
            while node is not None:
                if "" in node and total[i] + node[""][0] > total[j]:
                    total[j], back[j] = total[i] + node[""][0], (i, node[""][1])
                node, j = node.get(text[j]) if j < n else None, j + 1
            if text[i] not in self.usable and total[i] + self.worst > total[i + 1]:
                total[i + 1], back[i + 1] = total[i] + self.worst, (i, -1)
        out: list[int] = []
        alone, j = False, n
        while j:
            i, found = back[j]
            if found >= 0:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[i:j].encode())]
            elif not alone:
                out.append(self.unknown)
            alone, j = found < 0, i
        return out[::-1]

    def _merged(self, text: str) -> list[int]:
        """Ids after merging neighbours whose piece has the highest score, the leftmost among equals, until none is left."""
        parts: list[str] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def propose(i: int, j: int) -> None:
            if 0 <= i and j < len(parts) and (found := self.usable.get(parts[i] + parts[j])):
                heapq.heappush(heap, (-found[0], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            propose(i, i + 1)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j == len(parts) or parts[j] != y:  # one of them was merged since
                continue
            parts[i], parts[j], after[i] = x + y, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            propose(before[i], i)
            propose(i, after[i])
        return self._ids(filter(None, parts))

    def _ids(self, parts: Iterable[str]) -> list[int]:
        """Ids of pieces and of characters without one."""
        out: list[int] = []
        for p in parts:
            found = self.usable.get(p)
            out += [found[1]] if found else [self.bytes[b] for b in p.encode()] if self.bytes else [self.unknown] if out[-1:] != [self.unknown] else []
        return out

    def _tabulate(self) -> None:
        """Merges as arrays: numbers of pieces from 1 on, keys of pairs of them in order, and each pair's place in the order of scores.

        A character that no piece has gets the number behind the last; one that is only inside longer pieces gets 0.
        """
        number = {p: k for k, p in enumerate(self.usable, 1)}
        self.text_of = ["", *number]
        self.other = len(number) + 1
        self.ids_of = np.array([0, *(i for _, i in self.usable.values()), 0], np.int32)
        self.number_of = np.full(0x110000, self.other, np.int32)
        for c in set("".join(number)):
            self.number_of[ord(c)] = number.get(c, 0)
        rank = {x: k for k, x in enumerate(sorted({x for x, _ in self.usable.values()}))}
        self.base = len(number) + 2
        pairs = {}
        for p, k in number.items():
            for cut in range(1, len(p)):
                x, y = number.get(p[:cut]), number.get(p[cut:])
                if x and y:
                    pairs[x * self.base + y] = (rank[self.usable[p][0]], k)
        self.keys = np.array(sorted(pairs) or [0], np.int64)
        self.rank, self.merge = np.array([pairs.get(k, (-1, 0)) for k in self.keys.tolist()], np.int32).T.copy()

    def _pairs(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of scores, -1 for none, and numbers of the pieces of pairs."""
        key = x.astype(np.int64) * self.base + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        some = self.keys[at] == key
        return np.where(some, self.rank[at], -1), np.where(some, self.merge[at], 0)

    def _merged_rows(self, x: np.ndarray) -> np.ndarray:
        """Rows of numbers of pieces, 0 behind their ends, after all merges, one in each row at a time."""
        out, rows = np.zeros_like(x), np.arange(len(x))
        score = self._pairs(x[:, :-1], x[:, 1:])[0]
        while len(rows):
            k = score.argmax(1) if score.shape[1] else np.zeros(len(x), np.int64)
            live = np.take_along_axis(score, k[:, None], 1)[:, 0] >= 0 if score.shape[1] else np.zeros(len(x), bool)
            if not live.all():
                out[rows[~live], : x.shape[1]] = x[~live]
                x, score, k, rows = x[live], score[live], k[live], rows[live]
            if len(rows):
                every, width = np.arange(len(rows)), np.arange(x.shape[1] - 1)
                both = self._pairs(x[every, k], x[every, k + 1])[1]
                x = np.where(width > k[:, None], x[:, 1:], x[:, :-1])
                x[every, k] = both
                score = np.where(width[:-1] >= k[:, None], score[:, 1:], score[:, :-1])
                for some, left in ((k > 0, k - 1), (k < x.shape[1] - 1, k)):
                    at = every[some], left[some]
                    score[at] = self._pairs(x[at], x[at[0], at[1] + 1])[0]
        return out

    def _learn(self, slices: list[str]) -> None:
        """Segments slices and remembers them, as bytes of their ids."""
        if self.segment == self._merged:
            if not hasattr(self, "keys"):
                self._tabulate()
            flat = self.number_of[np.frombuffer("".join(slices).encode("utf-32-le", "surrogatepass"), np.uint32)]
            size = np.array([*map(len, slices)], np.int64)
            start = np.cumsum(size) - size
            known = np.minimum.reduceat(flat, start) > 0
            low = 0
            for high in WIDTHS:
                some = np.flatnonzero(known & (size > low) & (size <= high))
                low = high
                for i in range(0, len(some), TABLE_ROWS):
                    own = some[i : i + TABLE_ROWS]
                    places = np.arange(high) + start[own, None]
                    x = self._merged_rows(np.where(np.arange(high) < size[own, None], flat[np.minimum(places, len(flat) - 1)], 0))
                    data, ends = self.ids_of[x[x > 0]].tobytes(), np.cumsum((x > 0).sum(1) * 4).tolist()
                    self.held.update((slices[k], data[a:b]) for k, a, b in zip(own.tolist(), [0, *ends], ends, strict=False))
                    for r in np.flatnonzero((x == self.other).any(1)).tolist():
                        part = slices[own[r]]
                        others = (c for c in part if self.number_of[ord(c)] == self.other)
                        self.held[part] = np.array(self._ids(next(others) if k == self.other else self.text_of[k] for k in x[r].tolist() if k), np.int32).tobytes()
            slices = [slices[k] for k in np.flatnonzero(~known | (size > WIDTHS[-1])).tolist()]
        for part in slices:
            self.held[part] = np.array(self.segment(part), np.int32).tobytes()

    def encoded(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts, which are lists of slices, as bytes of 32-bit numbers."""
        if len(self.held) > REMEMBERED:
            self.held.clear()
        self.held[MARK] = np.array([self.usable[BLANK][1] if BLANK in self.usable else self.unknown, self.unknown], np.int32).tobytes()
        new = {part for t in texts for part in t if part not in self.held}
        if new:
            self._learn(list(new))
        return [b"".join(map(self.held.__getitem__, t)) for t in texts]

    @staticmethod
    def slices(text: str) -> list[str]:
        """Slices of a text, with a blank put before it; none for an empty one."""
        return SLICES.findall((BLANK + text).replace(" ", BLANK)) if text else []

    def ids(self, text: str) -> list[int]:
        """Ids of a text, with a blank put before it; none for an empty one."""
        return np.frombuffer(self.encoded([self.slices(text)])[0], np.int32).tolist()


def _together(texts: pa.Array, cut: Callable[[str], list[str]]) -> Iterator[list[list[str]]]:
    """Slices of texts, of some megabytes of text at a time; none for null."""
    out: list[list[str]] = []
    chars = 0
    for i in range(0, len(texts), ROWS):
        for t in texts.slice(i, ROWS).to_pylist():
            out.append(cut(t) if t else [])
            chars += len(t or "")
            if chars >= TOGETHER:
                yield out
                out, chars = [], 0
    if out:
        yield out


class Segmenter:
    """Column functions of a model's table of pieces; `model` is its kind."""

    def __init__(self, model: str, table: DataFrame):
        rows = [tuple(r) for r in table.select("id", "piece", "score", "kind").orderBy("id").limit(MOST_PIECES + 1).collect()]
        if len(rows) > MOST_PIECES:
            raise ValueError(f"a table of pieces may have {MOST_PIECES} rows")
        self.table, self.held = Pieces(model, rows), table.sparkSession.sparkContext.broadcast((model, rows))

    def _udf(self, cut: Callable[[str], list[str]], kind: T.DataType, values: Callable[[Pieces, np.ndarray], pa.Array]):
        held, made = self.held, []

        @F.arrow_udf(T.ArrayType(kind))
        def run(s: pa.Array) -> pa.Array:
            if not made:
                made.append(Pieces(*held.value))
            found = [b for some in _together(s, cut) for b in made[0].encoded(some)]
            ends = np.cumsum([0, *(len(b) // 4 for b in found)])
            mask = s.is_null() if s.null_count else None
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values(made[0], np.frombuffer(b"".join(found), np.int32)), mask=mask)

        return run

    def ids(self, text: Column) -> Column:
        """Ids of a text's pieces; null for null."""
        return self._udf(Pieces.slices, T.IntegerType(), lambda _, ids: pa.array(ids))(text)

    def ids_around(self, text: Column, unknown: str = "<unk>") -> Column:
        """The same with marks of unknown words: each becomes a blank's piece and the unknown id between its neighbours' ids."""

        def cut(t: str) -> list[str]:
            first, *rest = t.split(unknown)
            out = Pieces.slices(first)
            for part in rest:
                out.append(MARK)
                out += Pieces.slices(part)
            return out

        return self._udf(cut, T.IntegerType(), lambda _, ids: pa.array(ids))(text)

    def pieces(self, word: Column) -> Column:
        """Pieces of a word."""
        return self._udf(Pieces.slices, T.StringType(), lambda p, ids: pa.array([p.pieces[i] for i in ids.tolist()], pa.string()))(word)

    def lexicon(self, words: DataFrame, word: str = "word", oov: str = "<UNK>") -> DataFrame:
        """(word, tokens) of each distinct word, and a row of the unknown word: a blank's piece and the unknown piece."""
        own = words.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct().withColumn("tokens", self.pieces(F.col("word")))
        last = words.sparkSession.createDataFrame([(oov, [BLANK, self.table.pieces[self.table.unknown]])], own.schema)
        return own.unionByName(last)
