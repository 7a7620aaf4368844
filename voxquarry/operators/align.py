"""Word alignment and error scoring.

Alignment runs per reference/hypothesis pair inside a vectorised UDF that returns the aligned pairs as an array; spans,
allow-lists, counts and reports are DataFrame operations over the exploded pairs.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Four times the scores of the global alignment (match +2, substitution -1, gap -0.75), and the costs of minimum edits as scores.
SCORE, EDIT = (8, -4, -3), (0, -1, -1)
#: Hypotheses beyond this are labelled `runaway` by `guarded`: they say nothing.
MAX_WORDS = 5000
#: Cells up to which a pair is aligned without a band.
CELLS = 1 << 20
#: Cells of the bands of pairs that are aligned together, and most cells of one pair whose steps are all kept.
TOGETHER, ALONE = 1 << 19, 1 << 24
#: Words of a batch that are worked on at once; a longer row is worked on alone.
PIECE = 1 << 20
PAIRS = T.ArrayType(T.StructType([T.StructField("ref", T.StringType()), T.StructField("hyp", T.StringType())]))
COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in "msid"])
_FAR = -(1 << 30)


def _numbers(ref: list, hyp: list) -> tuple[np.ndarray, np.ndarray]:
    ids: dict = {}
    return np.array([ids.setdefault(w, len(ids)) for w in ref], np.int32), np.array([ids.setdefault(w, len(ids)) for w in hyp], np.int32)


class Band:
    """Rows of scores of the best alignments of two sequences of numbers, within `width` diagonals of both corners.

    Rows are scored at once: the insertion recurrence is a running maximum of score - gap * column. Every `every`-th row is
    kept, and the choices of the rows between are made again when the way back comes through them, so that memory grows
    with the square root of the matrix.
    """

    def __init__(self, r: np.ndarray, h: np.ndarray, scores: tuple[int, int, int], width: int):
        self.r, self.h, (self.match, self.sub, self.gap) = r, h, scores
        self.n, self.m = len(r), len(h)
        self.width, self.skew = width, self.m - self.n
        self.every = max(1, int(np.sqrt(self.n)))
        self.ramp = -self.gap * np.arange(self.m + 1, dtype=np.int32)
        self.kept: list[tuple[int, np.ndarray]] = []
        row = self._forward(0, self.n, self._first(), lambda i, row: i % self.every or self.kept.append((self._window(i)[0], row[slice(*self._window(i))].copy())))
        self.score = int(row[self.m])

    def _window(self, i: int) -> tuple[int, int]:
        """First column of a row, and the one behind its last."""
        return max(0, i + min(0, self.skew) - self.width), min(self.m, i + max(0, self.skew) + self.width) + 1

    def _first(self) -> np.ndarray:
        row = np.full(self.m + 2, _FAR, np.int32)
        end = self._window(0)[1]
        row[:end] = -self.ramp[:end]
        return row

    def _forward(self, begin: int, end: int, row: np.ndarray, seen, last: int | None = None) -> np.ndarray:
        """Rows begin to end - 1 in turn; seen(i, row i) before each step; columns behind `last` are left out."""
        h, cost = self.h, np.int32(self.match - self.sub)
        for i in range(begin, end):
            seen(i, row)
            lo, hi = self._window(i + 1)
            hi = hi if last is None else min(hi, last + 1)
            best = row[lo:hi] + np.int32(self.gap)
            one = max(lo, 1)
            np.maximum(best[one - lo :], row[one - 1 : hi - 1] + (h[one - 1 : hi - 1] == self.r[i]) * cost + np.int32(self.sub), out=best[one - lo :])
            best += self.ramp[lo:hi]
            np.maximum.accumulate(best, out=best)
            row[lo:hi] = best - self.ramp[lo:hi]
            if lo:
                row[lo - 1] = _FAR
        return row

    def certain(self) -> bool:
        """Whether no best alignment leaves the band: one that does has width + 1 pairs less and twice as many gaps more."""
        out = self.width + 1
        return out > min(self.n, self.m) or self.score > self.match * (min(self.n, self.m) - out) + self.gap * (abs(self.skew) + 2 * out)

    def path(self) -> np.ndarray:
        """Steps of the best alignment in order: 0 pair, 1 deletion, 2 insertion; ties prefer them in that order from the end."""
        out = np.zeros(self.n + self.m, np.uint8)
        k, i, j = len(out), self.n, self.m
        while i:
            begin = (i - 1) // self.every * self.every
            lo, kept = self.kept[begin // self.every]
            row = np.full(self.m + 2, _FAR, np.int32)
            row[lo : lo + len(kept)] = kept
            rows: list[tuple[int, np.ndarray]] = []
            low = max(0, self._window(begin)[0] - 1)
            row = self._forward(begin, i, row, lambda _, x, low=low, j=j, rows=rows: rows.append(x[low : j + 1].copy()), j)
            rows.append(row[low : j + 1])
            while i > begin:
                here, above = rows[i - begin], rows[i - begin - 1]
                v = here[j - low]
                k -= 1
                if j and v == above[j - 1 - low] + (self.match if self.h[j - 1] == self.r[i - 1] else self.sub):
                    i, j = i - 1, j - 1
                elif v == above[j - low] + self.gap:
                    out[k] = 1
                    i -= 1
                else:
                    out[k] = 2
                    j -= 1
        k -= j
        out[k : k + j] = 2
        return out[k:]


def best_band(r: np.ndarray, h: np.ndarray, scores: tuple[int, int, int]) -> Band:
    """The narrowest of doubling bands that certainly holds every best alignment; small pairs are done in one."""
    most = max(len(r), len(h))
    width = most if len(r) * len(h) <= CELLS else max(64, most // 64)
    while True:
        band = Band(r, h, scores, min(width, most))
        if width >= most or band.certain():
            return band
        width *= 2


def align_pairs(ref: list[str], hyp: list[str], legacy_column0: bool = False, scores: tuple[int, int, int] = SCORE) -> list[tuple[str | None, str | None]]:
    """Best-scoring global alignment; ties prefer a pair, then a deletion, then an insertion, from the end.

    `legacy_column0` stops the way back at column 0, which drops leading reference words.
    """
    out: list[tuple[str | None, str | None]] = []
    i = j = 0
    for step in best_band(*_numbers(ref, hyp), scores).path().tolist():
        if step == 1:
            if j or not legacy_column0:
                out.append((ref[i], None))
            i += 1
        elif step == 2:
            out.append((None, hyp[j]))
            j += 1
        else:
            out.append((ref[i], hyp[j]))
            i, j = i + 1, j + 1
    return out


def edit_pairs(ref: list[str], hyp: list[str]) -> list[tuple[str | None, str | None]]:
    """Minimum-edit alignment with unit costs; the same ties."""
    return align_pairs(ref, hyp, scores=EDIT)


def _laid(values: np.ndarray, at: np.ndarray, size: np.ndarray, places: np.ndarray, gap: int) -> np.ndarray:
    """(places, pairs) numbers of many sequences side by side, `gap` outside of them."""
    inside = (places[:, None] >= 0) & (places[:, None] < size)
    out = np.full(inside.shape, gap, values.dtype)
    out[inside] = values[(places[:, None] + at)[inside]]
    return out


def _bands(r: np.ndarray, h: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, sub: int, gap: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Costs and steps of the best alignments of many pairs of similar lengths, within `width` diagonals of their corners.

    Pairs are columns, and are in order of their lengths' sum; rows are the diagonals j - i of one parity. All cells of equal i + j
    are found at once from those one and two before, and hold which step leads to them. A match costs nothing, and the numbers of
    different words differ by at least `sub` in their bits.
    """
    (n, m), count = size, size.shape[1]
    ends, skew = n + m, m - n
    low = min(0, int(skew.min())) - width
    wide, last = (max(0, int(skew.max())) + width - low) // 2 + 1, int(ends[-1])
    top, base = (last - low) // 2, low // 2 - 1
    far = np.iinfo(r.dtype).max // 4 + 1
    ref = _laid(r, at[0], n, np.arange(top, -wide - 1, -1), far)
    hyp = _laid(h, at[1], m, np.arange(base, (last + low + 1) // 2 + wide), 2 * far)
    one, two = np.full((2, wide + 2, count), far // 2, r.dtype)
    pair, other = np.empty((2, wide, count), r.dtype)
    gaps, left = np.empty((2, wide, count), bool)
    steps = np.empty((last + 1, wide, count), np.uint8)
    steps[0] = 3
    one[-low // 2 + 1] = 0
    place = (skew - low) // 2
    cost, first = np.zeros(count, r.dtype), np.searchsorted(ends, np.arange(last + 2)).tolist()
    for k in range(1, last + 1):
        odd = (k - low) & 1
        i, j = top + 1 - (k - low) // 2, (k + low + odd) // 2 - 1 - base
        np.bitwise_xor(ref[i : i + wide], hyp[j : j + wide], out=pair)
        np.minimum(pair, sub, out=pair)
        pair += two[1:-1]
        delete, insert = one[1 + odd : 1 + odd + wide], one[odd : odd + wide]
        np.minimum(delete, insert, out=other)
        other += gap
        np.minimum(pair, other, out=two[1:-1])
        np.greater(pair, other, out=gaps)
        np.greater(delete, insert, out=left)
        left &= gaps
        np.add(gaps.view(np.uint8), left.view(np.uint8), out=steps[k])
        one, two = two, one
        if first[k] < first[k + 1]:
            done = np.arange(first[k], first[k + 1])
            cost[done] = one[place[done] + 1, done]
    row = wide * count  # the way back of all pairs; a gap changes the parity
    move = np.array([-2 * row, -row, -row - count, 0, -2 * row, -row + count, -row, 0])
    turn = np.array([0, 4, 4, 0, 4, 0, 0, 4], np.uint8)
    here, odd, back = ends * row + place * count + np.arange(count), ((skew - low) % 2 * 4).astype(np.uint8), []
    while (step := steps.take(here)).min() < 3:
        back.append(step)
        step = step + odd
        here += move.take(step)
        odd = turn.take(step)
    back = np.array(back[::-1], np.uint8).reshape(-1, count).T
    return cost, np.split(back[back < 3], np.cumsum((back < 3).sum(1))[:-1])


def _paths(r: np.ndarray, h: np.ndarray, size: np.ndarray, scores: tuple[int, int, int]) -> list[np.ndarray]:
    """Steps (`Band.path`) of each of many pairs; r and h hold the numbers of all words, `size` the lengths of both sides.

    Pairs of similar size and skew are aligned together, in bands that grow until they certainly hold every best path: a path
    that leaves a band has twice as many gaps more.
    """
    match, sub, gap = scores
    sub, gap = 2 * (match - sub), match - 2 * gap
    at = np.cumsum(size, axis=1) - size
    least, total, skew = size.min(0), size.sum(0), size[1] - size[0]
    width = np.minimum(np.maximum(8, least // 10), least)
    kind = np.int32 if max(r.max(initial=0), h.max(initial=0)) < 1 << 23 else np.int64
    r, h = ((x.astype(kind) << (sub - 1).bit_length()) for x in (r, h))
    out: list = [None] * len(total)
    todo = np.arange(len(total))
    while len(todo):
        todo = todo[np.lexsort((total[todo], skew[todo], total[todo] // 32))]
        low, high = np.minimum(0, skew) - width, np.maximum(0, skew) + width
        groups, again = [[]], []
        bounds = 0, 0, 0
        for k, a, b, t in zip(todo.tolist(), low[todo].tolist(), high[todo].tolist(), total[todo].tolist(), strict=True):
            bounds = min(a, bounds[0]), max(b, bounds[1]), max(t, bounds[2])
            if groups[-1] and (len(groups[-1]) + 1) * (bounds[2] + 1) * ((bounds[1] - bounds[0]) // 2 + 1) > TOGETHER:
                groups.append([])
                bounds = a, b, t
            groups[-1].append(k)
        for g in groups:
            g = np.array(g)[np.argsort(total[g], kind="stable")]
            if len(g) == 1 and (total[g[0]] + 1) * ((high[g[0]] - low[g[0]]) // 2 + 1) > ALONE:
                k = g[0]
                out[k] = best_band(*[x[a : a + n] for x, a, n in zip((r, h), at[:, k], size[:, k], strict=True)], scores).path()
                continue
            cost, steps = _bands(r, h, at[:, g], size[:, g], int(width[g].max()), sub, gap)
            sure = (width[g] >= least[g]) | (cost < gap * (abs(skew[g]) + 2 * width[g] + 2))
            for k, s, ok in zip(g.tolist(), steps, sure.tolist(), strict=True):
                out[k] = s if ok else None
            more = g[~sure]
            width[more] = np.minimum(np.minimum(2 * width[more], (cost[~sure] // gap - abs(skew[more])) // 2), least[more])
            again.append(more)
        todo = np.concatenate([np.zeros(0, np.int64), *again])
    return out


def _by_pieces(f):
    """A function of a batch, called for pieces of its rows."""

    @functools.wraps(f)
    def run(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        words = ref.offsets.to_numpy().astype(np.int64) + hyp.offsets.to_numpy()
        begin = np.flatnonzero(np.diff((words[1:] - words[0]) // PIECE, prepend=-1)).tolist() or [0]
        return pa.concat_arrays([f(ref.slice(a, b - a), hyp.slice(a, b - a)) for a, b in zip(begin, [*begin[1:], len(ref)], strict=True)])

    return run


def _batch(ref: pa.Array, hyp: pa.Array, scores: tuple[int, int, int]):
    """A batch's best alignments: rows without a null side, words of both sides, their numbers, and steps and lengths of all rows in a row."""
    ok = pc.and_(ref.is_valid(), hyp.is_valid())
    sides = [x.filter(ok) for x in (ref, hyp)]
    words = [x.flatten() for x in sides]
    coded = pa.chunked_array(words).dictionary_encode().combine_chunks()
    ids = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
    ids = ids[: len(words[0])], ids[len(words[0]) :]
    size = np.array([x.value_lengths().to_numpy() for x in sides], np.int64)
    paths = _paths(*ids, size, scores)
    return ok.to_numpy(zero_copy_only=False), words, ids, np.concatenate([np.zeros(0, np.uint8), *paths]), np.array([len(x) for x in paths], np.int64)


def _udf(scores: tuple[int, int, int], legacy_column0: bool = False):
    """Pairs as places in both sides, gathered by Arrow: no word of a batch becomes a Python object.

    Declared nondeterministic, as Spark evaluates others again for each filter (also those it adds to an explode) and pushes
    such filters below shuffles.
    """

    @F.arrow_udf(PAIRS)
    @_by_pieces
    def run(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        ok, words, _, steps, length = _batch(ref, hyp, scores)
        at = [np.cumsum(steps != gap, dtype=np.int32) - np.int32(1) for gap in (2, 1)]
        if legacy_column0:
            row = np.repeat(np.arange(len(length)), length)
            begin = np.cumsum(np.bincount(row, steps != 1, len(length))) - np.bincount(row, steps != 1, len(length))
            kept = (steps != 1) | (at[1] >= begin[row])
            at, steps, length = [x[kept] for x in at], steps[kept], np.bincount(row[kept], minlength=len(length))
        sides = [w.take(pa.array(x, mask=steps == gap)).cast(pa.string()) for w, x, gap in zip(words, at, (2, 1), strict=True)]
        sizes = np.zeros(len(ok) + 1, np.int32)
        sizes[1:][ok] = length
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.StructArray.from_arrays(sides, ["ref", "hyp"]), mask=pa.array(~ok))

    return run.asNondeterministic()


def _counted(scores: tuple[int, int, int]):
    """Matches, substitutions, insertions and deletions of each pair, without the pairs."""

    @F.arrow_udf(COUNTS)
    @_by_pieces
    def run(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        ok, _, ids, steps, length = _batch(ref, hyp, scores)
        i, j = [np.cumsum(steps != gap, dtype=np.int32) - 1 for gap in (2, 1)]
        pair = np.flatnonzero(steps == 0)
        steps[pair[ids[0][i[pair]] != ids[1][j[pair]]]] = 3
        ends = np.cumsum(length)
        out = np.zeros((4, len(ok)), np.int64)
        for row, kind in zip(out, (0, 3, 2, 1), strict=True):
            seen = np.append(0, np.cumsum(steps == kind))
            row[ok] = seen[ends] - seen[ends - length]
        return pa.StructArray.from_arrays([pa.array(x) for x in out], list("msid"), mask=pa.array(~ok))

    return run.asNondeterministic()


_score_udf, _legacy_udf, _edit_udf = _udf(SCORE), _udf(SCORE, True), _udf(EDIT)
_score_counts, _edit_counts = _counted(SCORE), _counted(EDIT)


def aligned(ref: Column, hyp: Column, method: str = "score") -> Column:
    """Aligned pairs of two word arrays of any length; null where either is null."""
    return {"score": _score_udf, "legacy": _legacy_udf, "edit": _edit_udf}[method](ref, hyp)


def guarded(runs: DataFrame, ref: str, hyp: str, method: str = "score", max_words: int = MAX_WORDS) -> DataFrame:
    """Adds status (`runaway` where the hypothesis has more than `max_words` words, else `scored`) and pairs (null for the former)."""
    status = F.when(F.size(hyp) > max_words, "runaway").otherwise("scored")
    return runs.withColumn("status", status).withColumn("pairs", aligned(F.col(ref), F.when(F.col("status") == "scored", F.col(hyp)), method))


def _chain(j: np.ndarray) -> np.ndarray:
    """Places of a longest run of anchors, which are in order of the other side, that rises."""
    ends, at, back = [], [], np.full(len(j), -1)
    for k, x in enumerate(j.tolist()):
        place = bisect.bisect_left(ends, x)
        back[k] = at[place - 1] if place else -1
        ends[place : place + 1], at[place : place + 1] = [x], [k]
    keep, k = [], at[-1] if at else -1
    while k >= 0:
        keep.append(k)
        k = back[k]
    return np.array(keep[::-1], np.int64)


def _runs(ids: np.ndarray, kinds: int, width: int) -> np.ndarray:
    """Numbers of the runs of `width` from each place on, equal for equal runs; the last places lack words and mean nothing."""
    out, n = ids.astype(np.int64), kinds
    for k in range(1, width):
        if n * kinds >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            n = len(out)
        out = out * kinds + np.append(ids[k:], np.zeros(min(k, len(ids)), ids.dtype))
        n *= kinds
    return out


def _cuts(ref: np.ndarray, hyp: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Cuts of one pair of sequences of numbered runs, from (0, 0) on."""
    out, runs = [(0, 0)], np.concatenate([ref, hyp])
    order = np.argsort(runs, kind="stable")
    new = np.concatenate([[True], np.diff(runs[order]) != 0, [True]])
    two = np.flatnonzero(new[:-2] & ~new[1:-1] & new[2:])
    i, j = order[two], order[two + 1] - len(ref)
    both = (i < len(ref)) & (j >= 0)
    order = np.argsort(i[both])
    i, j = i[both][order], j[both][order]
    if (np.diff(j) < 0).any():
        keep = _chain(j)
        i, j = i[keep], j[keep]
    while (k := int(np.searchsorted(i, out[-1][0] + least))) < len(i):
        out.append((int(i[k]), int(j[k])))
    return out


def anchored(runs: DataFrame, keys: list[str], ref: str, hyp: str, width: int = 3, least: int = 200, numbers: bool = False) -> DataFrame:
    """Cuts long pairs into rows that can be aligned apart: (keys, part, ref, hyp), parts in order from 0.

    Anchors are runs of `width` words that stand once in the reference and once in the hypothesis; those on a longest chain
    that rises on both sides are cuts, `least` reference words apart at least. The alignment through the cuts scores at most what
    the alignment of the whole does. A pair without anchors, or with a null side, is one part. Both sides stand in one row,
    so that cuts are found there; only the parts are dealt anew, each word once. With `numbers`, parts hold a number for each
    word, which is the same for equal words of a pair: that is all that counts need, in a fraction of the bytes.
    """
    cut = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))
    kind = T.StructType([T.StructField("cuts", cut)] + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ref", "hyp") if numbers])

    @F.arrow_udf(kind)
    @_by_pieces
    def cuts(r: pa.Array, h: pa.Array) -> pa.Array:
        words = [x.flatten() for x in (r, h)]
        coded = pa.chunked_array(words).dictionary_encode().combine_chunks()
        codes = coded.indices.fill_null(len(coded.dictionary))
        ids = _runs(codes.to_numpy(), len(coded.dictionary) + 1, width)
        ends = [np.append(0, np.cumsum(x.value_lengths().fill_null(0).to_numpy(), dtype=np.int32)) for x in (r, h)]
        sides = ids[: len(words[0])], ids[len(words[0]) :]
        rows = [_cuts(*[x[e[k] : max(e[k], e[k + 1] - width + 1)] for x, e in zip(sides, ends, strict=True)], least) for k in range(len(r))]
        at = np.array([c for row in rows for c in row], np.int32).reshape(-1, 2)
        out = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)], dtype=np.int32)), pa.StructArray.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], ["i", "j"]))]
        if numbers:
            values = codes[: len(words[0])], codes[len(words[0]) :]
            out += [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), v, mask=x.is_null()) for e, v, x in zip(ends, values, (r, h), strict=True)]
        return pa.StructArray.from_arrays(out, ["cuts", "ref", "hyp"][: len(out)])

    cuts = cuts.asNondeterministic()  # as in _udf
    t = runs.select(*keys, F.col(ref).alias("ref"), F.col(hyp).alias("hyp"), cuts(F.col(ref), F.col(hyp)).alias("_a"))
    t = t.select(*keys, *[(F.col(f"_a.{c}") if numbers else F.col(c)).alias(c) for c in ("ref", "hyp")], F.col("_a.cuts").alias("cuts"))
    t = t.select("*", F.posexplode("cuts").alias("part", "c"))
    to = F.try_element_at("cuts", F.col("part") + 2)
    side = lambda c, k: F.slice(c, F.col(f"c.{k}") + 1, F.coalesce(to[k], F.size(c)) - F.col(f"c.{k}"))
    return t.select(*keys, "part", side("ref", "i").alias("ref"), side("hyp", "j").alias("hyp")).repartition(*keys, "part")


def pair_totals(runs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp", method: str = "score") -> DataFrame:
    """What `totals` gives for spans of aligned pairs without allow-lists, counted where a row is aligned: no pair leaves it, only four numbers of a row move."""
    counts = {"score": _score_counts, "edit": _edit_counts}[method](F.col(ref), F.col(hyp))
    t = runs.select(*keys, counts.alias("_c")).groupBy(*keys).agg(*[F.sum(f"_c.{c}").alias(c) for c in "msid"]).where("m + s + i + d > 0")
    return t.select("*", *[x.alias(n) for n, x in rates(*[F.col(c) for c in "msid"]).items()])


def explode_pairs(runs: DataFrame, keys: list[str], pairs: str = "pairs") -> DataFrame:
    """(keys, pos, ref, hyp) of each aligned pair."""
    return runs.select(*keys, F.posexplode(pairs).alias("pos", "p")).select(*keys, "pos", "p.ref", "p.hyp")


def tag_spans(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds is_match and span: matches stand alone, consecutive mismatches between matches form one span."""
    match = (F.col("ref").isNotNull() & F.col("hyp").isNotNull() & (F.col("ref") == F.col("hyp"))).alias("is_match")
    w = Window.partitionBy(*keys).orderBy("pos")
    t = pairs.select("*", F.coalesce(match, F.lit(False)).alias("is_match"))
    opens = F.col("is_match") | F.coalesce(F.lag("is_match").over(w), F.lit(True))
    return t.withColumn("_o", opens.cast("int")).withColumn("span", F.sum("_o").over(w)).drop("_o")


def spans(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row a span: its texts and counts of matches, substitutions, insertions and deletions."""
    t = tag_spans(pairs, keys)
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("pos", c)))), lambda x: x[c]), " ")
    count = lambda cond: F.count_if(cond)
    return t.groupBy(*keys, "span").agg(
        text("ref").alias("ref_text"), text("hyp").alias("hyp_text"), F.min("pos").alias("pos"),
        count(F.col("is_match")).alias("m"),
        count(~F.col("is_match") & F.col("ref").isNotNull() & F.col("hyp").isNotNull()).alias("s"),
        count(F.col("ref").isNull()).alias("i"), count(F.col("hyp").isNull()).alias("d"),
    )


def apply_allow_lists(sp: DataFrame, replacements: DataFrame | None = None, insertions: DataFrame | None = None, deletions: DataFrame | None = None) -> DataFrame:
    """Adds `allowed` and applies it: an allowed mixed span counts as one match, allowed insertions and deletions as nothing.

    `replacements` (a, b) work both ways; `insertions` and `deletions` have a column text.
    """
    out = sp.withColumn("allowed", F.lit(False))
    if replacements is not None:
        both = replacements.select("a", "b").union(replacements.select("b", "a")).distinct().withColumn("_r", F.lit(True))
        out = out.join(both, (out["ref_text"] == both["a"]) & (out["hyp_text"] == both["b"]), "left").drop("a", "b")
        out = out.withColumn("allowed", F.col("allowed") | (F.coalesce("_r", F.lit(False)) & (F.col("ref_text") != "") & (F.col("hyp_text") != "") & (F.col("m") == 0))).drop("_r")
    for table, own, other in ((insertions, "hyp_text", "ref_text"), (deletions, "ref_text", "hyp_text")):
        if table is not None:
            t = table.select(F.col("text").alias("_t")).distinct()
            out = out.join(t, out[own] == t["_t"], "left")
            out = out.withColumn("allowed", F.col("allowed") | (F.col("_t").isNotNull() & (F.col(other) == "") & (F.col("m") == 0))).drop("_t")
    mixed = (F.col("ref_text") != "") & (F.col("hyp_text") != "")
    out = out.withColumn("m", F.when(F.col("allowed") & mixed, F.lit(1)).otherwise(F.col("m")).cast("long"))
    for c in "sid":
        out = out.withColumn(c, F.when(F.col("allowed"), F.lit(0)).otherwise(F.col(c)).cast("long"))
    return out


def rates(m: Column, s: Column, i: Column, d: Column) -> dict[str, Column]:
    """WER, recall, precision and F1, 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    recall, precision = ratio(m, m + s + d), ratio(m, m + s + i)
    return {"wer": ratio(s + i + d, m + s + d), "recall": recall, "precision": precision, "f1": ratio(2 * precision * recall, precision + recall)}


def totals(sp: DataFrame, keys: list[str]) -> DataFrame:
    """M, S, I, D and rates for each group of spans."""
    t = sp.groupBy(*keys) if keys else sp.groupBy()
    t = t.agg(*[F.sum(c).cast("long").alias(c) for c in "msid"])
    return t.select("*", *[x.alias(n) for n, x in rates(*[F.col(c) for c in "msid"]).items()])


def counters(sp: DataFrame) -> DataFrame:
    """Counted substitutions, insertions and deletions by text, for a report ordered by count and text."""
    bad = sp.where("NOT allowed AND s + i + d > 0")
    kind = F.when(F.col("ref_text") == "", "insertion").when(F.col("hyp_text") == "", "deletion").otherwise("substitution")
    return bad.groupBy(kind.alias("kind"), "ref_text", "hyp_text").agg(F.count(F.lit(1)).alias("n"))


def word_stats(pairs: DataFrame) -> DataFrame:
    """Per word: correct, substituted as reference, as hypothesis, inserted, deleted."""
    side = lambda c: pairs.where(F.col(c).isNotNull()).select(F.col(c).alias("word"), "ref", "hyp", F.lit(c).alias("side"))
    t = side("ref").union(side("hyp"))
    ref, hyp, one = F.col("ref"), F.col("hyp"), F.col("side")
    return t.groupBy("word").agg(
        F.count_if((one == "ref") & (ref == hyp)).alias("corr"), F.count_if((one == "ref") & (ref != hyp)).alias("ref_sub"),
        F.count_if((one == "hyp") & (ref != hyp)).alias("hyp_sub"), F.count_if(ref.isNull()).alias("ins"), F.count_if(hyp.isNull()).alias("del"),
    )


def attribute(pairs: DataFrame, keys: list[str], utt_of_ref: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(keys, utt, m, s, i, d): each error goes to the utterance of its own reference word, an insertion to that of the last
    reference word before it (0 if none), an allowed mixed span's one match to that of its first reference word.

    `utt_of_ref` is (keys, ref_pos, utt); `allowed` is (keys, span) with the allowed spans, mixed ones flagged by `mixed`.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    t = tag_spans(pairs, keys).withColumn("ref_pos", F.when(F.col("ref").isNotNull(), F.sum(F.col("ref").isNotNull().cast("int")).over(w) - 1))
    t = t.join(utt_of_ref, [*keys, "ref_pos"], "left")
    t = t.withColumn("utt", F.coalesce(F.last("utt", ignorenulls=True).over(w), F.lit(0)))
    if allowed is None:
        t = t.withColumn("_a", F.lit(False)).withColumn("mixed", F.lit(False))
    else:
        t = t.join(allowed.select(*keys, "span", "mixed", F.lit(True).alias("_a")), [*keys, "span"], "left").fillna(False, ["_a", "mixed"])
    first_ref = F.row_number().over(Window.partitionBy(*keys, "span").orderBy(F.col("ref").isNull(), "pos")) == 1
    t = t.withColumn("_f", first_ref & F.col("_a") & F.col("mixed"))
    ok, ref, hyp = ~F.col("_a") & ~F.col("is_match"), F.col("ref"), F.col("hyp")
    return t.groupBy(*keys, "utt").agg(
        F.count_if(F.col("is_match") | F.col("_f")).alias("m"), F.count_if(ok & ref.isNotNull() & hyp.isNotNull()).alias("s"),
        F.count_if(ok & ref.isNull()).alias("i"), F.count_if(ok & hyp.isNull()).alias("d"),
    )


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate; for an empty reference 0 if the hypothesis is empty too, else 1."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


def _edits(ref: list, hyp: list) -> int:
    """Minimum edits; what both sides begin and end with costs none and is left out."""
    most = min(len(ref), len(hyp))
    begin = next((k for k in range(most) if ref[k] != hyp[k]), most)
    end = next((k for k in range(most - begin) if ref[-1 - k] != hyp[-1 - k]), most - begin)
    ref, hyp = ref[begin : len(ref) - end], hyp[begin : len(hyp) - end]
    return -best_band(*_numbers(ref, hyp), EDIT).score if ref and hyp else len(ref) + len(hyp)


@F.pandas_udf(T.LongType())
def word_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Minimum word edits between two word arrays of any length."""
    return pd.Series([None if a is None or b is None else _edits(list(a), list(b)) for a, b in zip(ref, hyp, strict=True)], dtype="Int64")


def best_path(paths: DataFrame, keys: list[str], ref: str, hyp: str, path: str = "path_id") -> DataFrame:
    """The path of an n-best list with the fewest word edits (oracle), the smallest id among equals."""
    t = paths.withColumn("edits", word_distance(F.col(ref), F.col(hyp)))
    return t.groupBy(*keys).agg(F.min(F.struct("edits", path)).alias("b")).select(*keys, F.col(f"b.{path}").alias(path), F.col("b.edits").alias("edits"))


def project_segments(pairs: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Reference span of each hypothesis segment: (keys, seg, first_hyp, last_hyp) joined through aligned pairs, min to max."""
    w = Window.partitionBy(*keys).orderBy("pos")
    t = pairs.select(
        *keys, "ref", "hyp", F.when(F.col("ref").isNotNull(), F.sum(F.col("ref").isNotNull().cast("int")).over(w) - 1).alias("ref_pos"),
        F.when(F.col("hyp").isNotNull(), F.sum(F.col("hyp").isNotNull().cast("int")).over(w) - 1).alias("hyp_pos"),
    )
    t = t.where("ref_pos IS NOT NULL AND hyp_pos IS NOT NULL")
    # segments are spread over their words, so that the join is by equality
    words = segments.select(*keys, "seg", F.explode(F.sequence("first_hyp", "last_hyp")).alias("hyp_pos"))
    hit = words.join(t, [*keys, "hyp_pos"])
    return hit.groupBy(*keys, "seg").agg(F.min("ref_pos").alias("ref_start"), F.max("ref_pos").alias("ref_end"))


def bleu(pairs: DataFrame, keys: list[str], ref: str, hyp: str, order: int = 4) -> DataFrame:
    """Corpus BLEU: clipped n-gram matches, geometric mean, brevity penalty; 0 if an order has no match."""
    parts = []
    for n in range(1, order + 1):
        gram = lambda c, n=n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: F.array_join(F.slice(F.col(c), i + 1, n), " "))
        count = lambda c, n=n: pairs.where(F.size(c) >= n).select(*keys, "_id", F.explode(gram(c, n)).alias("g")).groupBy(*keys, "_id", "g").count()
        h, r = count(hyp).withColumnRenamed("count", "h"), count(ref).withColumnRenamed("count", "r")
        t = h.join(r, [*keys, "_id", "g"], "left").groupBy(*keys).agg(F.sum(F.least("h", F.coalesce("r", F.lit(0)))).alias("ok"), F.sum("h").alias("all"))
        parts.append(t.withColumn("n", F.lit(n)))
    t = parts[0]
    for p in parts[1:]:
        t = t.unionByName(p)
    t = t.groupBy(*keys).agg(F.avg(F.when(F.col("ok") > 0, F.log(F.col("ok") / F.col("all"))).otherwise(F.lit(float("-inf")))).alias("log_p"), F.count(F.lit(1)).alias("k"))
    size = pairs.groupBy(*keys).agg(F.sum(F.size(ref)).alias("r"), F.sum(F.size(hyp)).alias("h"))
    penalty = F.when(F.col("h") >= F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return size.join(t, keys, "left").select(*keys, F.when(F.coalesce(F.col("k"), F.lit(0)) < order, F.lit(0.0)).otherwise(penalty * F.exp("log_p")).alias("bleu"))
