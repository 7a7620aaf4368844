"""Online operators on Structured Streaming: turns, decode state, windows, quarantine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURN_SCHEMA = "session string, turn long, text string, truncated boolean"


def assemble_turns(events: DataFrame, idle_ms: int = 0) -> DataFrame:
    """Finished turns of a stream of (session, seq, kind, text), kinds start, interim, final, complete.

    `final` texts of a turn are joined; `complete` ends it; a turn that ends on an interim text is truncated and yields
    that text; `start` drops a pending interim text. A session that is idle for `idle_ms` ends as it stands.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, final, pending = state.get if state.exists else (0, "", "")
        out = []
        if state.hasTimedOut:
            if final or pending:
                out.append((key[0], turn, " ".join(x for x in (final, pending) if x), bool(pending)))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for kind, text in zip(rows["kind"], rows["text"], strict=True):
                if kind == "start":
                    pending = ""
                elif kind == "interim":
                    pending = text or ""
                elif kind == "final":
                    final, pending = " ".join(x for x in (final, text) if x), ""
                elif kind == "complete":
                    out.append((key[0], turn, " ".join(x for x in (final, pending) if x), bool(pending)))
                    turn, final, pending = turn + 1, "", ""
            state.update((turn, final, pending))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "turn", "text", "truncated"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("session").applyInPandasWithState(update, TURN_SCHEMA, "turn long, final string, pending string", "append", timeout)


def decode_streams(frames: DataFrame, chunk: int, score_fn: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """Per-utterance decoding of (utt, seq, token, last): frames are kept until `chunk` of them are there, or the last one
    comes; score_fn turns each chunk's frames into tokens and stands for a model; hypotheses are emitted when done."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, hyp, done = state.get if state.exists else ([], [], 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        held = list(held) + rows["token"].tolist()
        hyp = list(hyp)
        last = bool(rows["last"].any())
        while len(held) >= chunk or (last and held):
            part, held = held[:chunk], held[chunk:]
            hyp += [int(x) for x in score_fn(pd.DataFrame({"token": part}))]
            done += len(part)
        if last:
            state.remove()
            yield pd.DataFrame({"utt": [key[0]], "frames": [done], "hyp": [" ".join(map(str, hyp))]})
        else:
            state.update((held, hyp, done))

    return frames.groupBy("utt").applyInPandasWithState(update, "utt string, frames long, hyp string", "held array<long>, hyp array<long>, done long", "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, ts: str, size: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, ts: str, size: str, slide: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Sessions that an idle gap ends."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def quarantine(stream: DataFrame, good_path: str, bad_path: str, valid, checkpoint: str):
    """Writes rows that pass `valid` (a column) to one sink and the others, with their batch, to a dead-letter sink."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("_ok", F.coalesce(valid, F.lit(False))).persist()
        batch.where("_ok").drop("_ok").write.mode("append").parquet(good_path)
        batch.where("NOT _ok").drop("_ok").withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(bad_path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
