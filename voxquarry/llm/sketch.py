"""A fixed-size table of counts over hashed items, summed over all rows; it only orders and filters, never decides."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22
PART_BITS = 16
PARTS = 1 << (BITS - PART_BITS)
SCHEMA = "part long, blob binary"


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def rows(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The table in parts, packed."""
    for k, part in enumerate(counts.reshape(PARTS, -1)):
        if part.any():
            yield k, zlib.compress(part.astype(np.int64).tobytes(), 1)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            c = np.frombuffer(zlib.decompress(blob), np.int64)
            held[k] = held[k] + c if k in held else c
    for k, c in held.items():
        yield pa.RecordBatch.from_pydict({"part": [k], "blob": [zlib.compress(c.tobytes(), 1)]})


def levels(parts: DataFrame) -> np.ndarray:
    """Four times the base-2 logarithm of each cell's count, as bytes: 4 MB at the driver, whatever the input."""
    half = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("part", "g").drop("g")
    out = np.zeros(1 << BITS, np.uint8)
    for x in half.mapInArrow(_merge, SCHEMA).repartition("part").mapInArrow(_merge, SCHEMA).coalesce(8).toLocalIterator():
        c = np.frombuffer(zlib.decompress(x["blob"]), np.int64)
        out[x["part"] << PART_BITS : (x["part"] + 1) << PART_BITS] = np.minimum(255, np.round(4 * np.log2(1 + c)))
    return out
