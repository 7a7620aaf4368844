"""A bitmap of fixed size over 64-bit keys: it spares rows a shuffle, an exact join behind it decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MB, whatever the input; a full bitmap lets all rows pass.
BITS, PART_BITS = 27, 19


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        part, bit = (c.to_numpy() for c in batch.columns)
        for k in np.unique(part).tolist():
            packed, own = held.setdefault(k, np.zeros(1 << (PART_BITS - 3), np.uint8)), bit[part == k]
            np.bitwise_or.at(packed, own >> 3, (128 >> (own & 7)).astype(np.uint8))
    for k, packed in held.items():
        yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int64()), "bits": pa.array([packed.tobytes()], pa.binary())})


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """The bitmap of a column of longs, packed."""
    cell = F.shiftrightunsigned(key, 64 - BITS)
    cells = keys.select(F.shiftright(cell, PART_BITS).alias("part"), cell.bitwiseAND((1 << PART_BITS) - 1).alias("bit")).distinct()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (PART_BITS - 3)
    for x in cells.repartition("part").mapInArrow(_build, "part long, bits binary").coalesce(8).toLocalIterator():
        out[x["part"] * size : (x["part"] + 1) * size] = np.frombuffer(x["bits"], np.uint8)
    return out


def may_hold(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys.view(np.uint64) >> np.uint64(64 - BITS)
    return (packed[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
