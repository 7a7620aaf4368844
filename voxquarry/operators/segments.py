"""Time segments: packing, merging, chunking, splitting, masks, batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.operators.relational import running
from voxquarry.scratch import materialise

def _fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: T.StructType, fold) -> DataFrame:
    """An ordered fold of each group of `keys`: groups run in parallel, the rows of one in order.

    The fold sees a group's rows as arrays of `columns`; its memory is that of one group (a recording, a shard).
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = T.StructType([T.StructField(k, kinds[k]) for k in keys] + schema.fields)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        rows = fold(*[pdf[c].to_numpy() for c in columns])
        res = pd.DataFrame(rows, columns=schema.names)
        for k, v in zip(keys, key, strict=True):
            res.insert(0, k, v)
        return res[out.names]

    return df.groupBy(*keys).applyInPandas(run, out)


def pack(df: DataFrame, keys: list[str], order: str, duration: str, most: float = 602.0) -> DataFrame:
    """Next-fit packing: (keys, order, pack, start, end). A pack is closed before a segment that would pass `most`, and
    after one that reaches it."""
    schema = T.StructType([T.StructField(order, df.schema[order].dataType), T.StructField("pack", T.LongType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])

    def fold(ids, durations):
        rows, n, at = [], 1, 0.0
        for i, x in zip(ids, durations, strict=True):
            if at and at + x > most:
                n, at = n + 1, 0.0
            rows.append((i, n, at, at + x))
            at += x
            if at >= most:
                n, at = n + 1, 0.0
        return rows

    return _fold(df, keys, [order], [order, duration], schema, fold)


def expand_and_merge(df: DataFrame, key: str, start: str, end: str, total: Column, margin: float = 0.4) -> DataFrame:
    """Segments widened by a margin, clamped to 0..total, joined where one begins strictly before the previous one's end."""
    t = df.select(key, F.greatest(F.col(start) - margin, F.lit(0.0)).alias("start"), F.least(F.col(end) + margin, total).alias("end"))
    w = Window.partitionBy(key).orderBy("start", "end")
    t = t.withColumn("_n", F.coalesce((F.lag("end").over(w) <= F.col("start")).cast("int"), F.lit(1)))
    t = t.withColumn("_i", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # the end of a joined segment is that of its last part
    return t.groupBy(key, "_i").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end")).drop("_i")


def chunk(df: DataFrame, keys: list[str], start: str, end: str, most: float) -> DataFrame:
    """Greedy grouping: a chunk grows while its span stays within `most`; (keys, chunk, start, end, n)."""
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("n", T.LongType())])

    def fold(starts, ends):
        rows: list[list] = []
        for a, z in zip(starts, ends, strict=True):
            if rows and z - rows[-1][1] <= most:
                rows[-1][2], rows[-1][3] = z, rows[-1][3] + 1
            else:
                rows.append([len(rows), a, z, 1])
        return rows

    return _fold(df, keys, [start, end], [start, end], schema, fold)


def split_long(start: float, end: float, energy: np.ndarray, rate: float, most: float = 30.0, share: float = 0.05) -> list[tuple[float, float]]:
    """Splits a segment of more than `most` seconds at a quiet frame near its middle, again and again.

    A frame is quiet below the least energy plus `share` of the range; frames are tried outwards from the middle, right
    and left in turn, inside the segment; without one the middle itself is taken.
    """
    out, todo = [], [(start, end)]
    while todo:
        a, z = todo.pop()
        lo, hi = int(a * rate), min(int(z * rate), len(energy))
        if z - a <= most or hi - lo < 2:
            out.append((a, z))
            continue
        part, middle = energy[lo:hi], lo + (hi - lo) // 2
        limit = part.min() + share * (part.max() - part.min())
        at = middle
        if energy[middle] > limit:
            quiet = np.flatnonzero(part < limit) + lo
            if len(quiet):
                side = np.where(quiet > middle, 0, 1)
                at = int(quiet[np.lexsort((side, np.abs(quiet - middle)))[0]])
        if at in (lo, hi):
            at = middle
        mid = at / rate
        todo += [(mid, z), (a, mid)]
    return sorted(out)


def batches_by_length(df: DataFrame, keys: list[str], order: str, length: str, size: int, longest: int) -> DataFrame:
    """Dynamic batches over rows in order: a row of n * longest and more tokens counts n + 1 times less room; (keys, order, batch)."""
    schema = T.StructType([T.StructField(order, df.schema[order].dataType), T.StructField("batch", T.LongType())])

    def fold(ids, lengths):
        rows, n, i = [], 0, 0
        while i < len(ids):
            room = min(size // (int(lengths[i]) // longest + 1) + 1, size)
            rows += [(x, n) for x in ids[i : i + room]]
            n, i = n + 1, i + room
        return rows

    return _fold(df, keys, [order], [order, length], schema, fold)


def bucket_batches(df: DataFrame, length: str, order: str, edges: list[float], most: float) -> DataFrame:
    """Duration buckets with batches of at most `most` seconds: within a bucket rows go by a hash, a batch ends where the
    running sum passes a multiple of the limit."""
    b = F.lit(0)
    for e in edges:
        b = b + (F.col(length) > e).cast("int")
    t = running(df.withColumn("bucket", b).withColumn("_h", F.xxhash64(order)), ["bucket", "_h", order], F.col(length))
    first = t.groupBy("bucket").agg(F.min("before").alias("_f"))
    return t.join(F.broadcast(first), "bucket").withColumn("batch", F.floor((F.col("before") - F.col("_f")) / most)).drop("_h", "_f", "before")  # a row for each bucket


def quantile_edges(df: DataFrame, length: str, buckets: int, accuracy: int = 10_000) -> list[float]:
    """Inner edges of `buckets` buckets with as many rows each, from a quantile sketch of bounded size."""
    shares = [k / buckets for k in range(1, buckets)]
    found = df.agg(F.percentile_approx(length, shares, accuracy)).first()[0]
    return sorted(set(found or []))


def sampled_batches(df: DataFrame, key: str, length: str, edges: list[float], most: float, shards: int = 1, drop_last: bool = True, seed: str = "batch") -> DataFrame:
    """(key, bucket, shard, batch) of a bucketing sampler: rows of one bucket of lengths are dealt to shards and taken in order of
    hashes; a batch is closed before the row that would bring it over `most`. The last batch of a shard, which may not be
    full, is left out with `drop_last`.

    Choose so many shards that one of a bucket fits in a task. Keys must be unique; rows without a length are left out. A
    row longer than `most` is a batch alone.
    """
    draw = lambda what: F.crc32(F.concat(F.lit(f"{seed}|{what}|"), F.col(key).cast("string")).cast("binary"))
    bucket = sum(((F.col(length) > e).cast("int") for e in edges), F.lit(0))
    t = df.where(F.col(length).isNotNull()).select(key, F.col(length).cast("double").alias("_l"), bucket.alias("bucket"), (draw("shard") % shards).alias("shard"), draw("order").alias("_h"))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("batch", T.LongType())])

    def fold(ids, lengths):
        rows, n, total = [], 0, 0.0
        for i, x in zip(ids, lengths, strict=True):
            if total and total + x > most:
                n, total = n + 1, 0.0
            total += x
            rows.append((i, n))
        return [r for r in rows if r[1] < n] if drop_last else rows

    return _fold(t, ["bucket", "shard"], ["_h", key], [key, "_l"], schema, fold).select(key, "bucket", "shard", "batch")


def concatenate(df: DataFrame, keys: list[str], order: str, duration: str, gap: float) -> DataFrame:
    """Offsets of rows laid one after the other with a gap between."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(F.col(duration) + gap).over(w), F.lit(0.0)))


def noise_plan(df: DataFrame, key: str, share: float, low: float, high: float, seed: str = "noise") -> DataFrame:
    """Which rows get noise, and at what ratio: drawn from hashes of the key, so that reruns agree."""
    u = lambda what: F.pmod(F.crc32(F.concat(F.lit(f"{seed}|{what}|"), F.col(key).cast("string")).cast("binary")), F.lit(1 << 20)) / float(1 << 20)
    return df.withColumn("noisy", u("pick") < share).withColumn("snr", F.when(u("pick") < share, low + u("snr") * (high - low)))


def merge_chunks(symbols: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Symbols of overlapping chunks: each chunk keeps those in its core [left, right), moved to the recording's time.

    symbols (key, chunk, at, symbol), chunks (key, chunk, offset, left, right); cores are in chunk time.
    """
    t = symbols.join(chunks, [key, "chunk"]).where((F.col("at") >= F.col("left")) & (F.col("at") < F.col("right")))
    return t.select(key, "chunk", (F.col("at") + F.col("offset")).alias("at"), "symbol")


def core_gaps(chunks: DataFrame, key: str) -> DataFrame:
    """Cores that don't begin where the one before them ended; empty if they tile each recording."""
    w = Window.partitionBy(key).orderBy("offset")
    t = chunks.select(key, "chunk", "offset", (F.col("offset") + F.col("left")).alias("begin"), (F.col("offset") + F.col("right")).alias("finish"))
    return t.withColumn("before", F.lag("finish").over(w)).where("before IS NOT NULL AND abs(before - begin) > 1e-9").select(key, "chunk", "before", "begin")


def ticks(df: DataFrame, key: str, start: str, end: str, tick: float = 0.01) -> DataFrame:
    """Ticks that segments cover; ends round half to even, starts are clamped at 0."""
    a, z = F.greatest(F.rint(F.col(start) / tick), F.lit(0.0)).cast("long"), F.rint(F.col(end) / tick).cast("long")
    return df.where(z > a).select(key, F.explode(F.sequence(a, z - 1)).alias("tick")).distinct()


def hysteresis(active: np.ndarray, high: float, low: float, enter: int, leave: int) -> list[tuple[int, int]]:
    """Segments of a score series: entered after `enter` frames at or over `high`, left after `leave` at or under `low`;
    frames between the two leave the pending count as it is. A segment reaches from the first pending frame of its entry
    to that of its exit."""
    out, inside, begin, pending, since = [], False, 0, 0, -1
    for i, x in enumerate(active):
        toward = x >= high if not inside else x <= low
        back = x <= low if not inside else x >= high
        if toward:
            since = i if pending == 0 else since
            pending += 1
            if pending == (leave if inside else enter):
                if inside:
                    out.append((begin, since))
                else:
                    begin = since
                inside, pending = not inside, 0
        elif back:
            pending = 0
    if inside:
        out.append((begin, len(active)))
    return out


def edge_average(df: DataFrame, keys: list[str], order: str, column: str, reach: int, name: str) -> DataFrame:
    """Adds `name`: the mean of `reach` values to each side and the own one, the first and last value repeated beyond the ends."""
    w, part = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r, n = F.row_number().over(w), F.count(F.lit(1)).over(part)
    more = F.greatest(reach + 1 - r, F.lit(0)) * F.first(column).over(whole) + F.greatest(r + reach - n, F.lit(0)) * F.last(column).over(whole)
    return df.withColumn(name, (F.sum(column).over(w.rowsBetween(-reach, reach)) + more) / (2 * reach + 1))


#: Frames of a tile of the energy index.
TILE = 64


def energy_tiles(frames: DataFrame, key: str, frame: str, energy: str) -> DataFrame:
    """(key, tile, values, low, high, frames): energies of frames numbered from 0 in tiles, with each tile's range and the
    recording's number of frames. Tiles are the index that range minima and searches for quiet frames go through."""
    t = frames.groupBy(key, F.floor(F.col(frame) / TILE).alias("tile")).agg(F.transform(F.array_sort(F.collect_list(F.struct(frame, energy))), lambda x: x[energy]).alias("values"))
    n = t.groupBy(key).agg(F.sum(F.size("values")).alias("frames"))
    return t.select(key, "tile", "values", F.array_min("values").alias("low"), F.array_max("values").alias("high")).join(n, key)


def split_levels(segments: DataFrame, tiles: DataFrame, key: str, start: str, end: str, rate: float, most: float = 30.0, share: float = 0.05) -> DataFrame:
    """(key, start, end): segments of more than `most` seconds split at a quiet frame near their middle until none is left.

    A frame is quiet below the least energy of the segment plus `share` of its range. Unless the middle frame is at or below
    that, the nearest quiet frame is taken, the right one of two; one at the segment's first frame gives way to the middle.
    Segments of fewer than two frames, and of recordings without any, stay. All segments of a level are split together, by joins with the tiles that they
    meet; levels are written steps, and there are about as many as doublings of `most` in the longest segment.
    """
    tiles = materialise(tiles, "tiles")
    frames = tiles.select(key, "frames").distinct()
    t = segments.select(key, F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end")).join(frames, key, "left")
    done = []
    while True:
        first, last = F.floor(F.col("start") * rate), F.when(F.col("frames").isNotNull(), F.least(F.floor(F.col("end") * rate), F.col("frames")))
        t = t.withColumn("lo", first).withColumn("hi", last).withColumn("open", F.coalesce((F.col("end") - F.col("start") > most) & (last - first >= 2), F.lit(False)))
        t = materialise(t.withColumn("id", F.monotonically_increasing_id()), "split")
        done.append(t.where("NOT open").select(key, "start", "end"))
        todo = t.where("open").withColumn("middle", F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2))
        if todo.isEmpty():
            break
        at = F.explode(F.sequence(F.floor(F.col("lo") / TILE), F.floor((F.col("hi") - 1) / TILE))).alias("tile")
        met = todo.select(key, "id", "lo", "hi", "middle", at).join(tiles.drop("frames"), [key, "tile"])
        begin = F.greatest(F.col("lo") - F.col("tile") * TILE, F.lit(0)).cast("int")
        own = F.slice("values", begin + 1, F.least(F.col("hi") - F.col("tile") * TILE, F.lit(TILE)).cast("int") - begin)
        met = met.withColumn("own", own).withColumn("base", F.col("tile") * TILE + begin)
        low, high = F.min(F.array_min("own")), F.max(F.array_max("own"))
        here = F.max(F.get("own", (F.col("middle") - F.col("base")).cast("int")))
        limits = met.groupBy("id").agg((low + share * (high - low)).alias("limit"), here.alias("here"))
        limits = materialise(limits, "limits")
        # of frames at one distance the right one counts as nearer
        away = F.transform("own", lambda x, i: F.when(x < F.col("limit"), 2 * F.abs(F.col("base") + i - F.col("middle")) + (F.col("base") + i < F.col("middle")).cast("int")))
        quiet = met.where("low < high").join(limits.where("here > limit"), "id").where("low < limit").groupBy("id").agg(F.min(F.array_min(away)).alias("away"))
        t = todo.join(quiet, "id", "left")
        found = F.col("middle") + F.when(F.col("away") % 2 == 1, -F.floor(F.col("away") / 2)).otherwise(F.floor(F.col("away") / 2))
        found = F.when(F.col("away").isNull() | (found == F.col("lo")) | (found == F.col("hi")), F.col("middle")).otherwise(found)
        t = t.withColumn("mid", found / F.lit(float(rate)))
        t = t.select(key, "frames", F.explode(F.array(F.struct("start", F.col("mid").alias("end")), F.struct(F.col("mid").alias("start"), "end"))).alias("s")).select(key, "s.start", "s.end", "frames")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
