"""Quality scores from compression: a zstandard dictionary of good and one of bad text; the difference of a text's two
compressed sizes over its length, calibrated on other labelled rows, is its score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.llm.common import crc_mod, materialise, table

#: The dictionaries' sample: so many labelled rows of a class at most, and of a longer text a seeded piece of so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 1 << 15
DICT_BYTES, LEVEL = 1 << 16, 3
BINS, SPAN = 1024, 0.5


def train_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary's bytes: trained, or the texts themselves where they are too few to train on."""
    parts = [x[i : i + 2000] for x in texts for i in range(0, len(x), 2000)]
    try:
        return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes() if len(parts) >= 16 else b"\n".join(texts)[:size]
    except zstandard.ZstdError:
        return b"\n".join(texts)[:size]


def compressors(dictionaries: tuple[bytes, bytes]):
    out = []
    for d in dictionaries:
        held = zstandard.ZstdCompressionDict(d) if d else None
        if held is not None:
            held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def _gain(dictionaries: tuple[bytes, bytes]):
    """(compressed with bad - compressed with good) / bytes of each text; 0 for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = compressors(dictionaries)
        for batch in batches:
            gain = [(len(bad.compress(x)) - len(good.compress(x))) / len(x) if x else 0.0 for x in (t.encode() if t else b"" for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(gain, pa.float64())], [*[c for c in batch.schema.names if c != "text"], "gain"])

    return run


def bin_of(gain):
    return F.floor((F.greatest(F.least(gain, F.lit(SPAN)), F.lit(-SPAN)) + SPAN) / (2 * SPAN) * (BINS - 1)).cast("int")


def calibrate(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Probability of label 1 in each bin: pool-adjacent-violators over the bins' counts, shrunk to the prior, linear between pools."""
    n, prior = bad + good, (good.sum() + 1) / (bad.sum() + good.sum() + 2)
    if not good.sum() or not bad.sum():
        return np.full(BINS, prior)
    pools: list[list[float]] = []  # weight, positives, centre * weight
    for i in np.flatnonzero(n):
        pools.append([n[i], good[i], i * n[i]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    at = [p[2] / p[0] for p in pools]
    value = [(p[1] + prior) / (p[0] + 1) for p in pools]
    return np.interp(np.arange(BINS), at, np.maximum.accumulate(value))


def fit_dictionaries(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[bytes, bytes]:
    """Dictionaries (bad, good) from a sample of labelled texts: the first `rows` of a class by a hash of doc_id."""
    out = []
    for y in (0, 1):
        order = F.md5(F.concat(F.lit("dict:"), F.col("doc_id").cast("string")).cast("binary"))
        ids = F.broadcast(labels.where(F.col("quality") == y).select("doc_id").distinct().orderBy(order, "doc_id").limit(4 * rows))  # 4 * rows ids at most
        spare = F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0))
        piece = F.substr(F.col("text"), F.pmod(F.xxhash64("doc_id"), spare + 1).cast("int") + 1, F.lit(SAMPLE_CHARS))
        own = docs.join(ids, "doc_id").where("text <> ''").select("doc_id", piece.alias("text"))
        own = own.orderBy(order, "doc_id").limit(rows).collect()
        out.append(train_dictionary([x["text"].encode() for x in own]))
    return out[0], out[1]


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Drops `text` from docs (doc_id, text, ...) and adds score, learned from `labels` (doc_id, quality).

    Labels other than 0 and 1, null ids and labels of unknown documents teach nothing; repeated labels count again. Half
    of the labelled ids (by a hash) may go into the dictionaries' sample, all others calibrate. Null and empty texts have
    no size difference and get the score of that. Without labels of both classes every score is the smoothed share of 1.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    half = crc_mod(F.concat(F.lit("half:"), F.col("doc_id").cast("string")), 2)
    dictionaries = fit_dictionaries(docs.select("doc_id", "text"), known.where(half == 0), sample_rows)
    docs = docs.drop("gain", "score")
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    schema = T.StructType([*docs.drop("text").schema.fields, T.StructField("gain", T.DoubleType())])
    gains = materialise(docs.mapInArrow(lambda it: _gain(held.value)(it), schema), "quality-gain")
    bins = gains.select("doc_id", bin_of(F.col("gain")).alias("bin")).join(known.where(half == 1), "doc_id")
    counts = np.zeros((2, BINS))
    for x in bins.groupBy("bin", "quality").count().collect():  # BINS * 2 rows at most
        counts[x["quality"], x["bin"]] = x["count"]
    curve = F.array(*[F.lit(float(x)) for x in calibrate(counts[0], counts[1])])
    return gains.withColumn("score", F.element_at(curve, bin_of(F.col("gain")) + 1)).drop("gain")


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.where(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", "quality")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    out = score(docs.select("doc_id", held_out, "text"), learn)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))

