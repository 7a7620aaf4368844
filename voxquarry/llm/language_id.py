"""Language identification by error-correcting output codes.

Each language has a codeword; one linear n-gram classifier a bit predicts the bits of a text's codeword; the decoding
weighs each bit's loss by how reliable the bit was for the language in training, chooses the nearest codeword and flags
texts whose two nearest codewords are close. All counts come from all training rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.llm import arrays
from voxquarry.llm.common import crc_mod, table

DIMS = 1 << 16
UND = "und"


def codewords(n: int, bits: int = 24, tries: int = 200) -> np.ndarray:
    """n codewords of -1/1, one a row. Up to five languages: the exhaustive code; more: the best seeded random code by
    least distance, with as many bits as keep it apart. Every column splits the languages."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 5:
        cols = [[1 if c == 0 or not (v >> (c - 1)) & 1 else -1 for c in range(n)] for v in range(1, 2 ** (n - 1))]
        return np.array(cols, float).T
    bits = max(bits, int(np.ceil(10 * np.log2(n))))
    rng, best, far = np.random.default_rng(5), None, -1
    for _ in range(tries):
        m = rng.choice([-1.0, 1.0], (n, bits))
        bad = np.abs(m.sum(0)) == n
        m[0, bad] *= -1
        d = int(((bits - m @ m.T) / 2 + bits * np.eye(n)).min())
        if d > far:
            best, far = m, d
    return best


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every byte 3-gram and 4-gram in a row's lower-cased text; digits and ASCII punctuation are blanks."""
    b = arrays.lower(buf)
    blank = (b < 97) | ((b > 122) & (b < 128))
    b = np.where(blank, np.uint8(32), b).astype(np.uint32)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.int64)
    n = len(b)
    out_r, out_f = [], []
    for k in (3, 4):
        if n >= k:
            v = np.zeros(n - k + 1, np.uint32)
            gaps = np.zeros(n - k + 1, np.uint8)
            for i in range(k):
                v = v * np.uint32(257) + b[i : n - k + 1 + i]
                gaps += blank[i : n - k + 1 + i]
            ok = (rows[: n - k + 1] == rows[k - 1 :]) & (gaps < 2)
            out_r.append(rows[: n - k + 1][ok])
            out_f.append(((v[ok] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64))
    return (np.concatenate(out_r), np.concatenate(out_f)) if out_r else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for i, n, buf, offsets in arrays.chunks(batch.column("text")):
            r, f = grams(buf, offsets)
            for lang in set(langs[i : i + n]):
                mine = langs[i : i + n] == lang
                c = np.bincount(f[mine[r]], minlength=DIMS)
                held[lang] = held[lang] + c if lang in held else c
    for lang, c in held.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "part": [zlib.crc32(lang.encode()) & 0xFF], "counts": [zlib.compress(c.astype(np.int64).tobytes(), 1)]})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streaming sum of the counts of a partition: its memory holds one vector a language, however many rows come."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            c = np.frombuffer(zlib.decompress(blob), np.int64)
            held[lang] = held[lang] + c if lang in held else c
    for lang, c in held.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "part": [0], "counts": [zlib.compress(c.tobytes(), 1)]})


class Model:
    """Languages, codewords, bit weights by feature, reliability by language and bit, and the margin's scale."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray):
        self.langs, self.code, self.weights = langs, code, weights
        self.reliable = np.full(code.shape, 1.0 / max(1, code.shape[1]))
        self.scale = np.ones(code.shape[1])

    def margins(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log odds a feature, by row and bit."""
        r, f = grams(buf, offsets)
        n = len(offsets) - 1
        per = np.maximum(np.bincount(r, minlength=n), 1)
        out = np.empty((n, self.code.shape[1]))
        for b in range(self.code.shape[1]):
            out[:, b] = np.bincount(r, weights=self.weights[:, b][f], minlength=n) / per
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) of each row: the exponential loss of each bit, weighted by reliability."""
        n, k = len(margins), len(self.langs)
        if k == 1:
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        z = np.clip(margins / self.scale, -4, 4)
        loss = np.stack([(np.exp(-z * self.code[c]) * self.reliable[c]).sum(1) for c in range(k)], 1)
        p = np.exp(-3.0 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = np.argmin(loss, 1)
        top = p[np.arange(n), best]
        return best, top, top < 0.6


def _bit_stats(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, bits = model.code.shape
        right, sums, n = np.zeros((k, bits)), np.zeros((k, bits)), np.zeros(k)
        index = {x: i for i, x in enumerate(model.langs)}
        for batch in batches:
            y = np.array([index.get(x, -1) for x in batch.column("lang").to_pylist()])
            for i, rows, buf, offsets in arrays.chunks(batch.column("text")):
                m, yy = model.margins(buf, offsets), y[i : i + rows]
                for c in range(k):
                    own = m[yy == c]
                    right[c] += (own * model.code[c] > 0).sum(0)
                    sums[c] += np.abs(own).sum(0)
                    n[c] += len(own)
        c, b = np.indices((k, bits)).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"c": pa.array(c, pa.int32()), "b": pa.array(b, pa.int32()), "right": right.ravel(), "sums": sums.ravel(), "n": np.repeat(n, bits)})

    return run


def fit(labelled: DataFrame, smooth: float = 0.5) -> Model:
    """Learns from `labelled` (text, lang): two passes over all its rows, in which each task sums a vector a language.

    The driver gets one vector of DIMS counts for each language and a few numbers for each bit, whatever the number of
    rows. Null lang or text rows add nothing. No rows: a model without languages.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    schema = "lang string, part long, counts binary"
    per_task = rows.mapInArrow(_counts, schema).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
    merged = per_task.repartition("lang", "part").mapInArrow(_merge, schema).repartition("lang").mapInArrow(_merge, schema).collect()
    merged.sort(key=lambda x: x["lang"])
    langs = [x["lang"] for x in merged]
    counts = np.array([np.frombuffer(zlib.decompress(x["counts"]), np.int64) for x in merged], float).reshape(len(langs), DIMS)
    code = codewords(len(langs))
    share = (counts + smooth) / (counts + smooth).sum(1, keepdims=True) if len(langs) else counts
    weights = np.zeros((DIMS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        weights[:, b] = np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0))
    model = Model(langs, code, weights)
    if code.shape[1]:
        held = rows.sparkSession.sparkContext.broadcast(model)
        stats = rows.mapInArrow(lambda it: _bit_stats(held.value)(it), "c int, b int, right double, sums double, n double")
        for x in stats.groupBy("c", "b").agg(F.sum("right").alias("right"), F.sum("sums").alias("sums"), F.sum("n").alias("n")).collect():
            model.reliable[x["c"], x["b"]] = (x["right"] + 1) / (x["n"] + 2)
            model.scale[x["b"]] += x["sums"] / max(x["n"], 1)
        model.scale = np.maximum((model.scale - 1) / len(langs), 1e-6)
        model.reliable /= model.reliable.sum(1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous to docs; the prediction sees `text` only.

    Null text, text without a letter, or a model without languages: `und`, score 0, not ambiguous. Columns with the
    names of added ones are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            text = batch.column("text")
            pred, score, flag = [UND] * len(text), np.zeros(len(text)), np.zeros(len(text), bool)
            for i, n, buf, offsets in arrays.chunks(text) if m.langs else ():
                best, top, close = m.decode(m.margins(buf, offsets))
                for k in range(n):
                    own = buf[offsets[k] : offsets[k + 1]]
                    if ((own | 32) - 97 < 26).any() or any(map(str.isalpha, own.tobytes().decode())):
                        pred[i + k], score[i + k], flag[i + k] = m.langs[best[k]], top[k], close[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score), pa.array(flag)], [*batch.schema.names, "lang_pred", "score", "ambiguous"])


    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.mapInArrow(run, out)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_mod(F.col("doc_id"), 4) != 2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs).select("text", "lang"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    out = predict(docs.select("doc_id", held_out, "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
