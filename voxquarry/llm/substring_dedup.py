"""Passages that documents share, by MinHash banding of paragraphs.

Two kinds of paragraphs are compared. Lines of LINE_WORDS words and more are banded by minima of their word n-gram
hashes; lines that share a band are joined to a leader of the band and verified by exact Jaccard similarity, and all
others of a band that are still in different components are compared too. Windows of PIECE words, placed where the
content says so (the least hash of each REACH neighbouring places), find equal passages wherever they stand, inside a
line or over several: one of PIECE + REACH - 1 words holds at least one whole window. Equal paragraphs need no join.
Components of similar paragraphs become clusters. Runs of covered words are passages; of each cluster all but what is in
its smallest document are removals. Documents with equal words are one class: only one text of it is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxquarry.llm import arrays, membership, sketch
from voxquarry.llm.common import discard, materialise, release, small, table
from voxquarry.llm.components import connected_components

SHINGLE, PERCENT = 5, 80
#: Words of a window, neighbouring places of which one is chosen, and words of the shortest line that is banded.
PIECE, REACH, LINE_WORDS = 20, 21, 10
#: Bands and minima in each: lines of similarity 0.8 share a band with probability 1 - (1 - 0.8 ** 2) ** 4 = 0.983.
BANDS, MINIMA = 4, 2
#: Words of the shortest run that counts.
MIN_WORDS = 20
#: Rounds in which lines of open bands meet few others, at most, and lines that meet at once in the later ones.
ROUNDS, HAND = 3, 12
#: Words of documents whose runs are found at once.
RUN_WORDS = 1 << 20
#: Places of one cluster that meet in a task; a cluster with more is dealt over as many tasks.
SPREAD = 1 << 16
DOC, WINDOW, LINE = 0, 1, 2
_ODD = arrays.stream64(64, 21) | arrays.U(1)
_KINDS = {"kind": pa.int8()} | {c: pa.int64() for c in ("doc_id", "c", "c2", "h", "h2", "place", *(f"b{i}" for i in range(BANDS)))}
SCHEMA = ", ".join(f"{c} {'byte' if t == pa.int8() else 'long'}" for c, t in _KINDS.items())


class Words:
    """Words of a piece of a batch: hashes, rows, rows' first words and counts."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        buf = arrays.lower(buf)
        self.starts, ends, self.counts = arrays.words(buf, offsets)
        self.hash = arrays.word_hashes(buf, self.starts, ends)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        self.buf = buf

    def lines(self, least: int = LINE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """First word and size of each line of `least` words and more."""
        if not len(self.hash):
            return self.first[:0], self.first[:0]
        line = np.cumsum(self.buf == 10)[self.starts]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (self.row[1:] != self.row[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(line)))
        return at[size >= least], size[size >= least]

    def windows(self, piece: int = PIECE, reach: int = REACH) -> np.ndarray:
        """First words of the windows: of each `reach` neighbouring places where a window fits into the row, the one whose three words hash least."""
        n, places = len(self.hash), np.maximum(self.counts - piece + 1, 0)
        if not places.any():
            return np.zeros(0, np.int64)
        g = self.hash.copy()
        for k, weight in ((1, 3), (2, 7)):
            g[: n - k] += self.hash[k:] * np.uint64(weight)
        nth = (np.arange(n) - self.first[self.row]).astype(np.uint64)  # ties: the leftmost
        key = (arrays.mix64(g) & np.uint64(0xFFFFFFFF00000000)) | np.minimum(nth, np.uint64(0xFFFFFFFF))
        key[nth >= places[self.row].astype(np.uint64)] = np.uint64(0xFFFFFFFFFFFFFFFF)
        # least key of each `reach` places, by doubling; a row with fewer places is one stretch
        least, held = key.copy(), 1
        while held < reach:
            step = min(held, reach - held)
            least[: n - step] = np.minimum(least[: n - step], least[step:])
            held += step
        some = np.flatnonzero(places)
        stretches = np.maximum(places[some] - reach + 1, 1)
        at = np.repeat(self.first[some] - (np.cumsum(stretches) - stretches), stretches) + np.arange(int(stretches.sum()))
        short = np.repeat(places[some] < reach, stretches)
        chosen = np.empty(len(at), np.int64)
        chosen[~short] = (least[at[~short]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if short.any():
            few = some[places[some] < reach]
            ends = np.stack([self.first[few], self.first[few] + places[few]], 1).ravel()
            chosen[short] = (np.minimum.reduceat(np.append(key, key[:1]), ends)[::2] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return np.unique(self.first[self.row[at]] + chosen)


def bands(h: np.ndarray, first: np.ndarray, count: int = BANDS, minima: int = MINIMA) -> np.ndarray:
    """The bands of each line: `minima` least values of as many permutations of its n-gram hashes (from `first` on), mixed and tagged."""
    out = np.empty((len(first), count), np.uint64)
    for b in range(count if len(first) else 0):
        key = np.full(len(first), np.uint64(b + 1))
        for m in range(minima):
            key = arrays.mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * _ODD[b * minima + m], first))
        out[:, b] = key
    return out


def _line_shingles(t: Words, at: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, hash) of the k-word n-grams of lines, in order of lines."""
    words = np.arange(int(size.sum())) + np.repeat(at - (np.cumsum(size) - size), size)
    p, h = arrays.shingles(t.hash[words], size, k)
    if len(size) and size.min() < k:
        order = np.argsort(p, kind="stable")
        p, h = p[order], h[order]
    return p, h


def _rows(**columns) -> pa.RecordBatch:
    """A batch of SCHEMA; columns that are not given are null."""
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _KINDS.items()], list(_KINDS))


def _emit(k: int, piece: int, reach: int, line_words: int):
    """All that is compared, in one reading: a row for each document, window and line; a class that a task has met gives its paragraphs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = arrays.Once()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, n, buf, offsets in arrays.chunks(batch.column(1)):
                t = Words(buf, offsets)
                c, c2 = arrays.sequence_digests(t.hash, t.first, t.counts)
                yield _rows(kind=np.full(n, DOC, np.int8), doc_id=ids[i : i + n], c=c, c2=c2, place=t.counts)
                new = once.new(c)
                at = t.windows(piece, reach)
                at = at[new[t.row[at]]]
                if len(at):
                    h, h2 = arrays.sequence_digests(t.hash, at, np.full(len(at), piece))
                    row = t.row[at]
                    yield _rows(kind=np.full(len(at), WINDOW, np.int8), c=c[row], c2=c2[row], h=h, h2=h2, place=((at - t.first[row]) << 32) | piece)
                at, size = t.lines(line_words)
                keep = new[t.row[at]]
                at, size = at[keep], size[keep]
                if len(at):
                    row = t.row[at]
                    h, h2 = arrays.sequence_digests(t.hash, at, size)
                    p, grams = _line_shingles(t, at, size, k)
                    held = bands(grams, np.searchsorted(p, np.arange(len(at)))).view(np.int64)
                    yield _rows(kind=np.full(len(at), LINE, np.int8), c=c[row], c2=c2[row], h=h, h2=h2, place=((at - t.first[row]) << 32) | size, **{f"b{b}": held[:, b] for b in range(BANDS)})

    return run


def _grams(k: int, line_words: int, wanted):
    """(h, h2, n-grams) of the lines that the bitmap `wanted` may hold, each of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, packed = arrays.Once(), wanted.value
        for batch in batches:
            for _, _, buf, offsets in arrays.chunks(batch.column(0)):
                t = Words(buf, offsets)
                at, size = t.lines(line_words)
                h, h2 = arrays.sequence_digests(t.hash, at, size)
                keep = membership.may_hold(packed, h)
                keep[keep] = once.new(h[keep])
                at, size, h, h2 = at[keep], size[keep], h[keep], h2[keep]
                p, g = _line_shingles(t, at, size, k)
                order = np.lexsort((g, p))
                p, g = p[order], g[order]
                new = np.ones(len(p), bool)
                new[1:] = (p[1:] != p[:-1]) | (g[1:] != g[:-1])
                p, g = p[new], g[new]
                ends = np.searchsorted(p, np.arange(len(at) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([arrays.i64(h), arrays.i64(h2), pa.ListArray.from_arrays(pa.array(ends), arrays.i64(g))], ["h", "h2", "grams"])

    return run


def _id(h: str = "h", h2: str = "h2"):
    """128 bits of two longs as one value that orders and joins."""
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (h, h2)]))


def _similar(percent: int):
    """Whether the sets `grams` and `g` have the Jaccard similarity."""
    o = F.size(F.array_intersect("grams", "g"))
    return 100 * o >= percent * (F.size("grams") + F.size("g") - o)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, *keep: str) -> DataFrame:
    """(a, b, keep): the pairs (h, lead) that are similar. A pair names lines by 64 bits; all lines of these are told apart by 128.

    The n-grams of `lead`, which may have many partners, go to its pairs and from there to the other ends.
    """
    lead = sets.select(F.col("h").alias("lead"), F.col("h2").alias("lead2"), F.col("grams").alias("g"))
    both = pairs.join(lead, "lead").join(sets.select("h", "h2", "grams"), "h")
    return both.where(_similar(percent)).select(_id().alias("a"), _id("lead", "lead2").alias("b"), *keep)


def _may(x: str, y: str, percent: int):
    """Whether two lines can be similar by their sizes and the positions of a shared n-gram in the order."""
    need = F.ceil(percent * (F.col("n" + x) + F.col("n" + y)) / (100 + percent))
    return (F.col("n" + x) - F.col("pos" + x) >= need) & (F.col("n" + y) - F.col("pos" + y) >= need)


def _open(fronts: DataFrame) -> DataFrame:
    """The rows whose n-gram is in several components."""
    some = fronts.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok")
    return fronts.join(some, "tok", "left_semi")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task the table of n-gram counts."""
    counts = np.zeros(1 << sketch.BITS, np.int64)
    for batch in batches:
        np.add.at(counts, sketch.cell(batch.column(0).flatten().to_numpy().view(np.uint64)), 1)
    for part, blob in sketch.rows(counts):
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "blob": pa.array([blob], pa.binary())})


def _fronts(percent: int, order):
    """(line, component, n-grams, position, n-gram) of the first n - ceil(percent * n / 100) + 1 n-grams of each set in the order (level, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = order.value
        for batch in batches:
            n = pc.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            h, r = batch.column(2).flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(n)), n)
            by = np.lexsort((h, level[sketch.cell(h)], r))
            pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            front = pos < (n - (percent * n + 99) // 100 + 1)[r]
            line = pa.array(r[front])
            columns = [batch.column(0).take(line), batch.column(1).take(line), pa.array(n[r[front]].astype(np.int32)), pa.array(pos[front].astype(np.int32)), arrays.i64(h[by][front])]
            yield pa.RecordBatch.from_arrays(columns, ["h", "comp", "n", "pos", "tok"])

    return run


def _across(members: DataFrame, near: DataFrame, grams: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The links of lines in `members` (band, h, h2) that share a band and that `near` leaves in different components, and the steps they are read from.

    A band of a frequent passage can hold many lines, so its pairs are not formed: two sets of n and more n-grams that
    are similar enough share one of the first n - ceil(percent * n / 100) + 1 in a common order, here rare ones first.
    Lines that share such an n-gram meet its most central line first, the one with fewest rarer n-grams. Then,
    in ROUNDS rounds at most, those of each n-gram are dealt into hands of HAND lines that meet each other: their links join
    most of a group of variants at a cost in proportion to its size. Only lines that are still in different components
    after that all meet each other, each pair at the first n-gram that it shares.
    """
    comp = connected_components(near, "a", "b")
    held = members.withColumn("id", _id()).join(comp, F.col("id") == F.col("node"), "left").select("band", "h", "h2", F.xxhash64(F.coalesce("component", "id")).alias("comp"))
    held = materialise(held, "passages-held")
    open_ = held.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    held_open = held.join(open_, "band", "left_semi").select("h", "h2", "comp").distinct()
    sets = materialise(held_open.join(grams, ["h", "h2"]), "passages-open")
    discard(comp, held)
    counts = sets.select("grams").mapInArrow(_counts, sketch.SCHEMA)
    order = sets.sparkSession.sparkContext.broadcast(sketch.levels(counts))  # of fixed size
    fronts = sets.select("h", "comp", "grams").mapInArrow(_fronts(percent, order), "h long, comp long, n int, pos int, tok long")
    fronts = materialise(_open(fronts), "passages-fronts")
    order.unpersist()
    release(fronts.sparkSession)

    rest, found, steps, star = fronts, [], [sets, fronts], None
    side = lambda t, x: t.select("tok", *[F.col(c).alias(c + x) for c in ("h", "n", "pos", "comp")])
    for n in range(ROUNDS):
        if n == 0:  # the most central line leads; ties go by the n-gram
            lead = rest.groupBy("tok").agg(F.min_by(F.struct("h", "n", "pos", "comp"), F.struct("pos", F.xxhash64("h", "tok"))).alias("l")).select("tok", "l.*")
            met = side(rest, "x").join(side(lead, "y"), "tok")
        else:  # small hands of lines, dealt anew for each n-gram and round
            dealt = rest.join(rest.groupBy("tok").agg(F.ceil(F.count(F.lit(1)) / HAND).alias("hands")), "tok")
            dealt = dealt.withColumn("tok", F.struct("tok", F.pmod(F.xxhash64("h", "tok", F.lit(n)), "hands").alias("hand")))
            met = side(dealt, "x").join(side(dealt, "y"), "tok").where("hx < hy")
        met = met.where((F.col("compx") != F.col("compy")) & _may("x", "y", percent))
        met = materialise(met.select(F.col("hx").alias("h"), F.col("hy").alias("lead"), "compx", "compy").distinct(), "passages-star")
        links = materialise(_verified(met, sets, percent, "compx", "compy"), "passages-first")
        merged = connected_components(links, "compx", "compy")
        rest = rest.join(merged, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "comp")).drop("node", "component")
        rest = materialise(_open(rest), "passages-left")
        release(rest.sparkSession)
        star = met if star is None else star.unionByName(met)
        found.append(links)
        steps += [met, links, merged, rest]
        # partners in other components that a line still has at an n-gram, on average; few are compared at once
        m = rest.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("tok").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own"))
        m = m.agg(F.sum(F.col("m") * F.col("m") - F.col("own")), F.sum("m")).first()
        if (m[0] or 0) <= HAND * (m[1] or 0):
            break
    rest = materialise(rest.withColumn("prev", F.lag("tok").over(Window.partitionBy("h").orderBy("pos"))), "passages-left")
    x, y = (rest.select("tok", *[F.col(c).alias(c + side) for c in ("h", "n", "pos", "comp", "prev")]) for side in "xy")
    once = F.col("prevx").isNull() | F.col("prevy").isNull() | (F.col("prevx") != F.col("prevy"))
    pairs = x.join(y, "tok").where((F.col("hx") < F.col("hy")) & (F.col("compx") != F.col("compy")) & once & _may("x", "y", percent))
    seen = star.select(F.least("h", "lead").alias("h"), F.greatest("h", "lead").alias("lead"))
    pairs = pairs.select(F.col("hx").alias("h"), F.col("hy").alias("lead")).distinct().join(seen, ["h", "lead"], "left_anti")
    pairs = materialise(pairs, "passages-rest")
    found.append(materialise(_verified(pairs, sets, percent), "passages-across"))
    links = reduce(DataFrame.unionByName, [f.select("a", "b") for f in found])
    return links, [*steps, rest, pairs, found[-1]]


def line_links(kinds: DataFrame, texts: DataFrame, k: int = SHINGLE, percent: int = PERCENT, line_words: int = LINE_WORDS) -> DataFrame:
    """(a, b): links of similar, different lines of `kinds` (h, h2, b0 ...), whose texts are in `texts`; ids are of 128 bits."""
    spark = kinds.sparkSession
    members = kinds.select("h", "h2", F.explode(F.array(*[f"b{b}" for b in range(BANDS)])).alias("band"))
    lead = members.groupBy("band").agg(F.min("h").alias("lead"), F.max("h").alias("last")).where("lead <> last").select("band", "lead")
    members = materialise(members.join(lead, "band"), "passages-members")
    release(spark)
    pairs = materialise(members.where("h <> lead").select("h", "lead").distinct(), "passages-pairs")
    needed = members.select("h").distinct()
    wanted = spark.sparkContext.broadcast(membership.bitmap(needed, "h"))
    grams = texts.mapInArrow(_grams(k, line_words, wanted), "h long, h2 long, grams array<long>")
    grams = materialise(grams.join(needed, "h", "left_semi").dropDuplicates(["h", "h2"]), "passages-grams")
    release(spark)
    near = materialise(_verified(pairs, grams, percent), "passages-near")
    release(spark)
    more, steps = _across(members.select("band", "h", "h2"), near, grams, percent)
    links = materialise(near.unionByName(more), "passages-links")
    wanted.unpersist()
    discard(members, pairs, grams, near, *steps)
    return links


def _runs(min_words: int, percent: int, gap: int):
    """(doc, first word, words, cluster, keeper) of each run of covered words, of `min_words` words in all, cut where the keeper changes.

    A word goes by the smallest keeper of the paragraphs that cover it: what is removed always stays in its keeper. Up to
    `gap` uncovered words between two runs of one keeper join them if `percent` of the whole is covered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lens = batch.column(0).to_numpy(), pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
            first, n, cluster, keeper = batch.column(1).flatten().flatten()
            first, n, keeper = (x.to_numpy() for x in (first, n, keeper))
            rank = pc.rank(cluster, tiebreaker="dense").to_numpy().astype(np.int64)
            starts = np.cumsum(lens) - lens
            width = np.cumsum(np.maximum.reduceat(first + n, starts) + 1) if len(ids) else lens
            i = 0
            while i < len(ids):  # documents of about RUN_WORDS words at once, each with a free word behind it
                past = int(width[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(width, past + RUN_WORDS, side="right")))
                held = slice(int(starts[i]), int(starts[j - 1] + lens[j - 1]))
                row = np.repeat(np.arange(i, j), lens[i:j])
                base = np.where(row > 0, width[row - 1], 0) - past
                order = np.lexsort((first[held], rank[held], keeper[held]))[::-1]  # the smallest keeper is written last
                size, at = n[held][order], (base + first[held])[order]
                words = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
                owner = np.full(int(width[j - 1]) - past + 1, -1)
                owner[words] = np.repeat(order, size)
                on = owner >= 0
                opens, ends = (np.flatnonzero(x) for x in (on & ~np.append(False, on[:-1]), on & ~np.append(on[1:], False)))
                left, right = owner[ends[:-1]], owner[opens[1:]]
                between, whole = opens[1:] - ends[:-1] - 1, ends[1:] + 1 - opens[:-1]
                joined = (row[left] == row[right]) & (keeper[held][left] == keeper[held][right]) & (between <= gap) & (100 * between <= (100 - percent) * whole)
                for a, z, own in zip((ends[:-1] + 1)[joined], opens[1:][joined], left[joined], strict=True):
                    owner[a:z] = own
                on = owner >= 0
                who = np.where(on, keeper[held][owner], 0)
                opens = on & ~np.append(False, on[:-1])
                cut = np.flatnonzero(opens | on & np.append(False, who[1:] != who[:-1]))
                ends = np.flatnonzero(on & ~np.append(on[1:], False)) + 1
                nth = np.cumsum(opens)[cut] - 1  # the run of each piece
                stop = np.where(np.append(nth[1:], -1) == nth, np.append(cut[1:], 0), ends[nth])
                keep = (ends - np.flatnonzero(opens))[nth] >= min_words
                cut, stop = cut[keep], stop[keep]
                own = owner[cut]
                names = cluster.slice(held.start, held.stop - held.start).take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [arrays.i64(ids[row[own]]), arrays.i64(cut - base[own]), arrays.i64(stop - cut), names, arrays.i64(keeper[held][own])],
                    ["doc_id", "first_word", "n_words", "cluster", "keeper_doc_id"],
                )
                i = j

    return run


def repeated_passages(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, min_words: int = MIN_WORDS, piece: int = PIECE, reach: int = REACH, line_words: int = LINE_WORDS) -> DataFrame:
    """(doc_id, first_word, n_words, cluster, keeper_doc_id, removed) for each passage of docs (doc_id, text) that other documents share.

    Words are runs of characters other than ASCII white space, counted from 0; A-Z are lower-cased. A run of words of
    paragraphs that are similar to some of another document counts if it has `min_words` words in all. It is cut into
    passages where the keeper changes, so a passage can be shorter. `cluster` names the first paragraph's cluster,
    keeper_doc_id is the smallest document in it, and `removed` says whether the passage goes: in all documents but the
    keeper. Of documents with equal words all but the smallest are one passage each, kept by it; what it has of others
    may go in turn, but a copy always stays. Null and empty texts have no passages. Rows that repeat a doc_id are one
    document; what it repeats of itself is no passage. A null doc_id is left out, as a passage of it could not be named.
    Paragraphs and classes are told apart by 128-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    rows = materialise(docs.mapInArrow(_emit(k, piece, reach, line_words), SCHEMA), "passages-rows")
    named = rows.where(F.col("kind") == DOC).select("doc_id", "c", "c2", F.col("place").alias("n"))
    classes = materialise(named.groupBy("c", "c2", "n").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last")), "passages-classes")

    # equal windows of different classes
    windows = rows.where(F.col("kind") == WINDOW).select("h", "h2", "c", "c2", "place")
    shared = windows.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")
    shared = materialise(shared, "passages-shared")
    release(spark)
    equal = windows.join(shared, "h", "left_semi").distinct().select("c", "c2", "place", _id().alias("cluster"))
    equal = materialise(equal, "passages-windows")
    discard(shared)

    # equal and similar lines
    lines = rows.where(F.col("kind") == LINE)
    kinds = lines.groupBy("h", "h2").agg((F.min("c") != F.max("c")).alias("many"), *[F.max(f"b{b}").alias(f"b{b}") for b in range(BANDS)])
    kinds = materialise(kinds, "passages-kinds")
    release(spark)
    links = line_links(kinds, docs.select("text"), k, percent, line_words)
    comp = connected_components(links, "a", "b")
    held = kinds.select("h", "h2", "many", _id().alias("id")).join(comp, F.col("id") == F.col("node"), "left").where(F.col("many") | F.col("node").isNotNull())
    held = held.select("h", "h2", F.coalesce("component", "id").alias("cluster"))
    alike = materialise(lines.select("h", "h2", "c", "c2", "place").join(held, ["h", "h2"]).select("c", "c2", "place", "cluster").distinct(), "passages-lines")
    discard(kinds, links, comp)

    places = equal.unionByName(alike).join(classes.select("c", "c2", "doc"), ["c", "c2"]).select("doc", "place", "cluster")
    places = materialise(places, "passages-places")
    discard(equal, alike)
    spans = places.groupBy("cluster").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("m")).where("keeper <> last")
    spans = materialise(spans.select("cluster", "keeper", F.ceil(F.col("m") / SPREAD).cast("int").alias("salts")), "passages-spans")
    hot = small(materialise(spans.where("salts > 1").select("cluster", "salts"), "passages-hot"))
    dealt = places.join(hot, "cluster", "left").withColumn("salt", F.pmod(F.xxhash64("doc"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    hits = dealt.join(spans, ["cluster", "salt"]).select("doc", F.shiftright("place", 32).alias("first"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("n"), "cluster", "keeper")
    copied = classes.where((F.col("doc") != F.col("last")) & (F.col("n") >= min_words)).withColumn("cluster", _id("c", "c2"))
    hits = hits.unionByName(copied.select("doc", F.lit(0).cast("long").alias("first"), "n", "cluster", F.col("doc").alias("keeper")))
    per_doc = hits.groupBy("doc").agg(F.collect_list(F.struct("first", "n", "cluster", "keeper")).alias("hits"))
    runs = per_doc.mapInArrow(_runs(min_words, percent, 2 * reach), "doc_id long, first_word long, n_words long, cluster binary, keeper_doc_id long")
    copies = named.join(copied.select("c", "c2", "n", "doc", "cluster"), ["c", "c2", "n"]).where(F.col("doc_id") != F.col("doc")).distinct()
    copies = copies.select("doc_id", F.lit(0).cast("long").alias("first_word"), F.col("n").alias("n_words"), "cluster", F.col("doc").alias("keeper_doc_id"))
    out = runs.unionByName(copies)
    return out.withColumn("cluster", F.lower(F.hex("cluster"))).withColumn("removed", F.col("doc_id") != F.col("keeper_doc_id"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
