"""Scores over several output channels, symbol delays, and lexicon graphs as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.operators.relational import running

#: Positions in the channels from `lo` on, and the least cost of reaching each.
Box = tuple[tuple[int, ...], np.ndarray]
_NEVER = 1 << 28
#: Utterances whose subsets may be tried all, and cells of a box that cost as much as one word read for one subset.
MOST_TRIED = 14
CELLS_A_WORD = 300


def _cropped(lo: tuple[int, ...], cost: np.ndarray, alive: np.ndarray) -> Box | None:
    """The smallest box around the positions that are alive; others in it are never reached."""
    cost = np.where(alive, cost, _NEVER)
    for axis in range(cost.ndim):
        some = np.flatnonzero(alive.any(tuple(k for k in range(cost.ndim) if k != axis)))
        if not len(some):
            return None
        cut = slice(some[0], some[-1] + 1)
        cost, alive = (np.take(x, range(cut.start, cut.stop), axis) for x in (cost, alive))
        lo = (*lo[:axis], lo[axis] + cut.start, *lo[axis + 1 :])
    return lo, cost


def _merged(boxes: list[Box]) -> Box | None:
    """The least of several boxes at every position."""
    if not boxes:
        return None
    low = tuple(min(x) for x in zip(*[lo for lo, _ in boxes], strict=True))
    high = tuple(max(x) for x in zip(*[np.add(lo, c.shape) for lo, c in boxes], strict=True))
    out = np.full(np.subtract(high, low), _NEVER, np.int32)
    for lo, c in boxes:
        at = tuple(slice(i - j, i - j + n) for i, j, n in zip(lo, low, c.shape, strict=True))
        out[at] = np.minimum(out[at], c)
    return low, out


class _Reader:
    """Costs of utterances in order over positions in the channels, as far as no more than `budget` errors can come of it."""

    def __init__(self, refs: list[np.ndarray], channels: list[np.ndarray], budget: int):
        self.refs, self.channels, self.budget = refs, channels, budget
        self.left = np.concatenate([np.cumsum([len(r) for r in refs][::-1])[::-1], [0]])

    def first(self) -> Box | None:
        shape = [min(len(c), self.budget) + 1 for c in self.channels]
        return self.kept((0,) * len(shape), np.indices(shape).sum(0).astype(np.int32), 0)

    def kept(self, lo: tuple[int, ...], cost: np.ndarray, done: int) -> Box | None:
        """Positions from which the end can be reached within the budget: what is left on both sides differs by so many errors at least."""
        rest = -int(self.left[done])
        for axis, (i, c) in enumerate(zip(lo, self.channels, strict=True)):
            rest = rest + (len(c) - i - np.arange(cost.shape[axis])).reshape([-1 if k == axis else 1 for k in range(cost.ndim)])
        return _cropped(lo, cost, cost + np.abs(rest) <= self.budget)

    def read(self, box: Box | None, u: int, axis: int) -> Box | None:
        """Costs once utterance u is aligned behind each position of one channel."""
        if box is None:
            return None
        lo, cost = box
        cost, channel, words = np.moveaxis(cost, axis, 0), self.channels[axis], self.refs[u]
        more = min(len(channel) + 1 - lo[axis] - len(cost), len(words) + self.budget - int(cost.min()))
        cost = np.concatenate([cost, np.full((max(more, 0), *cost.shape[1:]), _NEVER, np.int32)])
        heard = channel[lo[axis] : lo[axis] + len(cost) - 1]
        ramp = np.arange(len(cost), dtype=np.int32).reshape(-1, *[1] * (cost.ndim - 1))
        for w in words:
            best = cost + 1
            best[1:] = np.minimum(best[1:], cost[:-1] + (heard != w).astype(np.int32).reshape(ramp[1:].shape))
            cost = np.minimum.accumulate(best - ramp, axis=0) + ramp
        return self.kept(lo, np.moveaxis(cost, 0, axis), u + 1)

    def step(self, box: Box | None, u: int) -> Box | None:
        return _merged([b for k in range(len(self.channels)) if (b := self.read(box, u, k)) is not None])


def _meet(ahead: Box | None, back: Box | None, sizes: list[int]) -> int:
    """The least sum at one position of costs so far and of costs to go, which are by distance from the ends."""
    if ahead is None or back is None:
        return _NEVER
    (lo, cost), (far, rest) = ahead, back
    rest = rest[tuple(slice(None, None, -1) for _ in sizes)]
    start = tuple(n - i - k + 1 for n, i, k in zip(sizes, far, rest.shape, strict=True))
    low, high = np.maximum(lo, start), np.minimum(np.add(lo, cost.shape), np.add(start, rest.shape))
    if (low >= high).any():
        return _NEVER
    cut = lambda at, x: x[tuple(slice(i - j, k - j) for i, j, k in zip(low, at, high, strict=True))]
    return int((cut(lo, cost) + cut(start, rest)).min())


def _within(refs: list[np.ndarray], channels: list[np.ndarray], budget: int) -> tuple[int, list[int]] | None:
    """(errors, channel of each utterance), the first of equals, if there are at most `budget` errors.

    Costs to go are read backwards and kept every so many utterances; the way forward makes them again between those.
    """
    sizes, n = [len(c) for c in channels], len(refs)
    back = _Reader([r[::-1] for r in refs[::-1]], [c[::-1] for c in channels], budget)
    ahead = _Reader(refs, channels, budget)
    every = max(1, int(np.sqrt(n)))
    held: dict[int, Box | None] = {}
    box = back.first()
    for v in range(n):
        if v % every == 0:
            held[v] = box
        box = back.step(box, v)
    here = ahead.first()
    least = _meet(here, box, sizes) if n else int(sum(sizes))
    if least > budget:
        return None
    who: list[int] = []
    block: dict[int, Box | None] = {}
    for u in range(n):
        to_go = n - u - 1  # utterances behind u
        if to_go not in block:
            v = to_go // every * every
            block = {v: held[v]}
            for i in range(v, to_go):
                block[i + 1] = back.step(block[i], i)
        for k in range(len(channels)):
            mine = ahead.read(here, u, k)
            if _meet(mine, block[to_go], sizes) == least:
                break
        who.append(k)
        here = mine
    return least, who


def _subset_errors(refs: list[list[str]], channel: list[str]) -> list[int]:
    """Edit distance to a channel of every subset of the utterances, by the subset's number: the first utterance is its highest bit.

    A column of the distance table is two whole numbers, whose bits say where it rises and falls, so that a word costs a few sums
    of whole numbers. A subset goes on from that of its earlier utterances.
    """
    all_ = (1 << len(channel)) - 1
    at: dict[str, int] = {}
    for i, w in enumerate(channel):
        at[w] = at.get(w, 0) | 1 << i
    states = [(all_, 0, 0)]
    for ref in refs:
        heard = [at.get(w, 0) for w in ref]
        longer = []
        for up, down, words in states:
            for same in heard:
                x = (((same & up) + up) ^ up) | same | down
                rise, fall = (down | ~(x | up)) << 1 | 1, (up & x) << 1
                v = same | down
                up, down = (fall | ~(v | rise)) & all_, rise & v & all_
            longer += [(up, down, words + len(heard))]
        states = [s for pair in zip(states, longer, strict=True) for s in pair]
    return [words + up.bit_count() - down.bit_count() for up, down, words in states]


def _tried(refs: list[list[str]], channels: list[list[str]]) -> tuple[int, list[int]]:
    """(errors, channel of each utterance), the first of equals, of two channels: each subset in the second, the rest in the first."""
    first, second = (_subset_errors(refs, c) for c in channels)
    errors = [a + b for a, b in zip(reversed(first), second, strict=True)]
    least = min(errors)
    return least, [errors.index(least) >> k & 1 for k in reversed(range(len(refs)))]


def best_assignment(refs: list[list[str]], channels: list[list[str]]) -> tuple[int, list[int]]:
    """(errors, channel of each utterance): utterances keep their order within a channel; the assignment with fewest errors,
    the first of equals.

    A dynamic programme over positions in the channels, restricted to what a budget of errors allows; the budget doubles
    until it is enough, which proves the result. Work grows with the words and the square of the errors (for two channels), memory
    with that square and the root of the number of utterances. Few utterances over two channels have all their subsets tried
    instead, as soon as a budget costs more than that.
    """
    if not channels:
        return sum(map(len, refs)), [0] * len(refs)
    ids: dict[str, int] = {}
    numbers = lambda words: np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    r, c = [numbers(x) for x in refs], [numbers(x) for x in channels]
    budget = abs(sum(map(len, r)) - sum(map(len, c))) + 8
    tries = CELLS_A_WORD * 2 ** (len(r) + 1) // max(len(r), 1) if len(c) == 2 and len(r) <= MOST_TRIED else None
    found = None
    while found is None:
        if tries is not None and np.prod([min(len(x), budget) + 1 for x in c]) > tries:
            return _tried(refs, channels)
        found = _within(r, c, budget)
        budget *= 2
    return found


def assign_channels(refs: Column, channels: Column) -> Column:
    """struct(errors, words, assignment) of an array of reference utterances and one of channel outputs, both of word arrays."""
    kind = T.StructType([T.StructField("errors", T.LongType()), T.StructField("words", T.LongType()), T.StructField("assignment", T.ArrayType(T.LongType()))])

    @F.pandas_udf(kind)
    def run(r: pd.Series, c: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(r, c, strict=True):
            a = [list(x) for x in a]
            e, who = best_assignment(a, [list(x) for x in b])
            out.append((e, sum(map(len, a)), who))
        return pd.DataFrame(out, columns=["errors", "words", "assignment"])

    return run(refs, channels)


def symbol_delay(pairs: DataFrame, keys: list[str], ref_time: str, hyp_time: str) -> DataFrame:
    """(keys, n, mean, var): delay of correct symbols and its population variance; both infinite where none is correct."""
    delay = F.when(F.col("ref") == F.col("hyp"), F.col(hyp_time) - F.col(ref_time))
    t = pairs.groupBy(*keys).agg(F.count(delay).alias("n"), F.avg(delay).alias("mean"), F.var_pop(delay).alias("var"))
    inf = F.lit(float("inf"))
    return t.select(*keys, "n", F.coalesce("mean", inf).alias("mean"), F.coalesce("var", inf).alias("var"))


def lexicon_arcs(lexicon: DataFrame, order: str) -> DataFrame:
    """(word, pos, src, dst, token, out): a loop of token chains at state 0; the first arc of a chain gives out the word."""
    t = running(lexicon, [order], F.size("tokens") - 1, "_b")
    t = t.select("word", "_b", F.size("tokens").alias("_n"), F.posexplode("tokens").alias("pos", "token"))
    src = F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.col("_b") + F.col("pos"))
    dst = F.when(F.col("pos") == F.col("_n") - 1, F.lit(0)).otherwise(F.col("_b") + F.col("pos") + 1)
    return t.select("word", "pos", src.cast("long").alias("src"), dst.cast("long").alias("dst"), "token", F.when(F.col("pos") == 0, F.col("word")).otherwise(F.lit("<eps>")).alias("out"))


def with_flexible_token(lexicon: DataFrame, token: str = "<star>") -> DataFrame:
    """The lexicon with one more entry, a token that stands for any missing or surplus word in weak transcripts."""
    extra = lexicon.sparkSession.createDataFrame([(token, [token])], "word string, tokens array<string>")
    return lexicon.select("word", "tokens").unionByName(extra)


def mel_filters(bands: int, fft: int, rate: float, low: float, high: float) -> np.ndarray:
    """Triangular filters (bands, fft // 2 + 1), evenly spaced in mel."""
    mel = lambda f: 1127.0 * np.log(1 + f / 700.0)
    edges = np.linspace(mel(low), mel(high), bands + 2)
    bins = mel(np.arange(fft // 2 + 1) * rate / fft)
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))
