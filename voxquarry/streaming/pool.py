"""Decoding of many streams by a bounded pool of active ones: admission, round-robin chunks, draining.

Each lane is a decoder that holds at most so many active streams. Streams are admitted in order; as soon as the lane is
full, all active ones get a chunk in turn until one is done and leaves. What is active stays in Spark's keyed state between
micro-batches, one list entry a stream, with the lane's clock beside it; a lane is drained by its end mark or when nothing came for a while.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Frames behind an utterance are padded with the logarithm of almost nothing.
SILENCE = math.log(1e-10)
RESULT = "lane long, utt string, frames long, chunks long, hyp string, begin long, end long"
STREAM = "num long, utt string, frames array<double>, taken long, state array<double>, hyp array<long>, begin long"
#: (windows of the active streams, their states) to (new tokens, new states): what a model does with a batch of chunks.
Score = Callable[[list[list[float]], list[list[float]]], tuple[list[list[int]], list[list[float]]]]


class _Lane(StatefulProcessor):
    def __init__(self, active: int, chunk: int, overlap: int, tail: int, score: Score, initial: list[float], idle_ms: int):
        self.active, self.chunk, self.overlap, self.tail = active, chunk, overlap, tail
        self.score, self.initial, self.idle_ms = score, initial, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streams = handle.getListState("streams", STREAM)
        self.clock = handle.getValueState("clock", "round long, timer long")

    def _round(self, pool: list[list], now: int, out: list[tuple], lane: int) -> int:
        """One chunk for every active stream; those that are done leave."""
        windows = [s[2][s[3] : s[3] + self.chunk + self.overlap] for s in pool]
        tokens, states = self.score(windows, [s[4] for s in pool])
        for s, new, state in zip(pool, tokens, states, strict=True):
            s[3], s[4], s[5] = s[3] + self.chunk, state, s[5] + list(new)
        for s in pool:
            if s[3] >= len(s[2]):
                out.append((lane, s[1], len(s[2]) - self.overlap - self.tail, -(-s[3] // self.chunk), " ".join(map(str, s[5])), s[6], now + 1))
        pool[:] = [s for s in pool if s[3] < len(s[2])]
        return now + 1

    def _held(self) -> tuple[list[list], int, int]:
        pool = [[n, u, list(f), t, list(s), [int(x) for x in h], b] for n, u, f, t, s, h, b in self.streams.get()] if self.streams.exists() else []
        return pool, *(self.clock.get() if self.clock.exists() else (0, 0))

    def _keep(self, pool: list[list], now: int, timer: int) -> None:
        if pool:
            self.streams.put([tuple(s) for s in pool])
        elif self.streams.exists():
            self.streams.clear()
        self.clock.update((now, timer))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pool, now, timer = self._held()
        out: list[tuple] = []
        new = pd.concat(list(rows))
        ended = bool(new["utt"].isna().any())
        for num, utt, frames in new[new["utt"].notna()].sort_values("num", kind="stable")[["num", "utt", "frames"]].itertuples(index=False):
            own = [float(x) for x in (frames if frames is not None else ())] + [SILENCE] * (self.overlap + self.tail)
            pool.append([int(num), utt, own, 0, self.initial, [], now])
            while len(pool) >= self.active:
                now = self._round(pool, now, out, int(key[0]))
        while ended and pool:
            now = self._round(pool, now, out, int(key[0]))
        if self.idle_ms:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms if pool else 0
            if timer:
                self.handle.registerTimer(timer)
        self._keep(pool, now, timer)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pool, now, _ = self._held()
        out: list[tuple] = []
        while pool:
            now = self._round(pool, now, out, int(key[0]))
        self._keep(pool, now, 0)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    def close(self) -> None:
        pass


def decode_pool(streams: DataFrame, active: int, chunk: int, score: Score, initial: list[float], overlap: int = 13, tail: int = 30, idle_ms: int = 0) -> DataFrame:
    """(lane, utt, frames, chunks, hyp, begin, end) of each decoded utterance of a stream of (lane, num, utt, frames).

    Utterances of a lane are admitted in order of `num` within a micro-batch; a row without `utt` is the lane's end mark and
    drains it, as does `idle_ms` without rows. `score` sees chunks of `chunk` frames and `overlap` more; frames are padded by
    `overlap` and `tail`. begin and end are the lane's rounds: at most `active` utterances have begun and not ended. Empty
    frames are padding only. Needs the state store that `with_rocksdb` sets.
    """
    if min(active, chunk) < 1:
        raise ValueError("active and chunk are at least 1")
    lane = _Lane(active, chunk, overlap, tail, score, initial, idle_ms)
    mode = "ProcessingTime" if idle_ms else "None"
    return streams.groupBy("lane").transformWithStateInPandas(lane, RESULT, "Append", mode)


class with_rocksdb:  # noqa: N801
    """Sets the state store that such operators need while a stream starts and runs, and what was set before afterwards."""

    KEY, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.KEY)
        self.conf.set(self.KEY, self.STORE)

    def __exit__(self, *_) -> None:
        self.conf.set(self.KEY, self.before)
