"""Audio and feature files: size probes, PCM decoding, HTK features. Python's own codecs and NumPy, in Arrow batches."""

from __future__ import annotations

import io
import math
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.functions.text import wav_seconds


def probe(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """(path, bytes, duration, samples) from file sizes; contents aren't read."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return t.select("path", F.col("length").alias("bytes"), wav_seconds(F.col("length"), rate).alias("duration"), F.floor((F.col("length") - 44) / 2).alias("samples"))


def resample(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    """Samples at another rate by a polyphase filter: ceil(n * rate / own) of them.

    A sinc that ends at the lower of the two Nyquist frequencies, ten of its periods to each side under a Kaiser window;
    every output takes the filter's phase that belongs to its place between two inputs. Beyond the ends there is silence.
    """
    g = math.gcd(own, rate)
    up, down = rate // g, own // g
    if up == down or not len(x):
        return x
    most = max(up, down)
    half = 10 * most
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / most) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    reach = -(-half // up)
    x = np.pad(x, reach + 1)
    out = np.empty(-(-(len(x) - 2 * reach - 2) * up // down))
    near = np.arange(-reach, reach + 2)
    for i in range(0, len(out), 1 << 14):
        at = np.arange(i, min(i + (1 << 14), len(out))) * down  # places on the grid of both rates
        base = at // up
        tap = at[:, None] - (base[:, None] + near) * up + half
        weight = np.where((tap >= 0) & (tap <= 2 * half), taps[np.clip(tap, 0, 2 * half)], 0.0)
        out[i : i + len(at)] = (x[np.clip(base[:, None] + near + reach + 1, 0, len(x) - 1)] * weight).sum(1)
    return out


def decode(data: bytes, rate: int = 16000) -> np.ndarray:
    """16-bit mono samples at `rate`: channels averaged, resampled by a polyphase filter."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float64) / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(1)
    x = resample(x, own, rate)
    return np.clip(np.rint(x * 32767), -32768, 32767).astype(np.int16)


def encode(samples: np.ndarray, rate: int = 16000) -> bytes:
    """A 16-bit file of samples, or of samples by channels."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1] if samples.ndim == 2 else 1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def read_audio(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """(path, pcm, duration): 16-bit little-endian samples of each file."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pcm = [decode(x, rate) for x in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "pcm": [x.astype("<i2").tobytes() for x in pcm], "duration": [len(x) / rate for x in pcm]})

    return t.mapInPandas(run, "path string, pcm binary, duration double")


@F.pandas_udf(T.BinaryType())
def _end_to_end(parts: pd.Series) -> pd.Series:
    return parts.map(lambda x: b"".join(x))


def concatenate(audio: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One PCM string for each group, parts in order; a group has to fit in memory, as one output file does."""
    g = audio.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "pcm"))).alias("l"))
    return g.select(*keys, _end_to_end(F.transform("l", lambda x: x["pcm"])).alias("pcm"))


def scale(x: np.ndarray) -> np.ndarray:
    """Divided by its peak, then by its deviation."""
    x = x / max(np.abs(x).max(), 1e-9) if len(x) else x
    return x / (x.std() + 1e-6) if len(x) else x


# ---- HTK feature files (fixed values of the format: big-endian head of samples, period, bytes a vector, kind) ----------

COMPRESSED = 0o2000


def write_htk(features: np.ndarray, period: int = 100_000, kind: int = 9) -> bytes:
    return struct.pack(">iihh", len(features), period, features.shape[1] * 4, kind) + features.astype(">f4").tobytes()


def read_htk(data: bytes) -> tuple[np.ndarray, int, int]:
    """(features, period, kind); compressed files hold 16-bit values with a scale and an offset for each column."""
    n, period, size, kind = struct.unpack(">iihh", data[:12])
    if kind & COMPRESSED:
        cols = size // 2
        a, b = np.frombuffer(data, ">f4", cols, 12), np.frombuffer(data, ">f4", cols, 12 + 4 * cols)
        return (np.frombuffer(data, ">i2", (n - 4) * cols, 12 + 8 * cols).reshape(-1, cols) + b) / a, period, kind
    if kind & 63 == 0:  # waveform
        return np.frombuffer(data, ">i2", n, 12).astype(np.float64).reshape(-1, 1), period, kind
    return np.frombuffer(data, ">f4", n * size // 4, 12).astype(np.float64).reshape(n, size // 4), period, kind


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, features) of HTK files."""
    t = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                x = read_htk(c)[0]
                yield pd.DataFrame({"path": p, "frame": np.arange(len(x)), "features": list(x)})

    return t.mapInPandas(run, "path string, frame long, features array<double>")
